import random
import tempfile
import zlib
from collections import Counter, defaultdict

from tessera.llm.sharding import SLOTS, assign, grow, load_map, newest, rebalance, save_map, shard, slot_sizes, slotted


def gapless(rows):
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    return all(sorted(p) == list(range(len(p))) for p in places.values())


def test_sizes_places_and_balance(documents):
    r = random.Random(1)
    rows = [(k, "".join(r.choice("abé ") for _ in range(int(r.expovariate(0.01))))) for k in range(2000)]
    got = shard(documents(rows), 8).collect()
    texts = dict(rows)
    assert sorted(x.doc_id for x in got) == list(range(2000)) and gapless(got)
    assert all(x.size == len(texts[x.doc_id].encode()) + 1 and x.text_crc32 == zlib.crc32(texts[x.doc_id].encode()) for x in got)
    load = Counter()
    for x in got:
        load[x.shard] += x.size
    assert len(load) == 8 and max(load.values()) < 1.02 * min(load.values())


def test_copies_stay_together_unless_hot(documents):
    rows = [(k, "hot" * 50) for k in range(900)] + [(1000 + k, f"text {k // 3} " * 10) for k in range(1800)]
    got = shard(documents(rows), 8).collect()
    groups = defaultdict(set)
    for x in got:
        groups[x.text_crc32].add(x.shard)
    load = Counter(x.shard for x in got)
    assert sum(len(g) > 1 for g in groups.values()) == 1 and len(groups[zlib.crc32(b"hot" * 50)]) == 8
    assert gapless(got) and max(load.values()) < 1.4 * min(load.values())


def test_odd_rows(documents, odd):
    got = shard(documents(odd), 3).collect()
    assert len(got) == len(odd) and gapless(got) and all(x.size == 1 and x.text_crc32 == 0 for x in got if x.doc_id in (1, 2, 3))
    assert shard(documents([]), 3).count() == 0


def test_growth_moves_slots_into_the_new_shard_only(spark, documents):
    r = random.Random(2)
    sizes = {s: r.randint(1, 1000) for s in range(SLOTS)}
    first = assign(sizes, 8)
    more = grow(first, sizes)
    moved = [k for k in range(SLOTS) if first[k] != more[k]]
    load = Counter()
    for k in range(SLOTS):
        load[more[k]] += sizes[k]
    assert moved and all(more[k] == 8 for k in moved) and max(load.values()) < 1.05 * min(load.values())
    path = tempfile.mkdtemp(prefix="spark-") + "/map"
    save_map(spark, first, 1, path)
    save_map(spark, more, 2, path)
    assert load_map(spark, path) == more and load_map(spark, path, 1) == first
    got = shard(documents([(k, "t" * k) for k in range(300)]), map_path=path).collect()
    assert all(x.shard == more[x.vslot] and x.map_version == 2 for x in got) and gapless(got)


def test_a_map_is_made_kept_and_rebalanced(spark, documents):
    docs, path = documents([(k, f"text {k} " * (k % 40)) for k in range(3000)]), tempfile.mkdtemp(prefix="spark-") + "/map"
    first = {x.doc_id: x for x in shard(docs, 4, map_path=path).collect()}
    again = {x.doc_id: x.shard for x in shard(docs, 7, map_path=path).collect()}  # the stored map has four shards
    assert newest(spark, path) == 1 and again == {k: x.shard for k, x in first.items()}
    assert rebalance(spark, path, slot_sizes(slotted(docs))) == 2
    more = {x.doc_id: x for x in shard(docs, 4, map_path=path).collect()}
    assert all(x.map_version == 2 and x.shard == first[k].next_shard and x.shard in (4, first[k].shard) for k, x in more.items())
    load = Counter()
    for x in more.values():
        load[x.shard] += x.size
    assert len(load) == 5 and max(load.values()) < 1.05 * min(load.values()) and gapless(more.values())


def test_places_of_a_row_repeated_very_often(documents):
    rows = [(7, "same")] * 3000 + [(None, "same")] * 50 + [(k, f"t{k}" * 9) for k in range(200)]
    got = shard(documents(rows), 3).collect()
    assert len(got) == len(rows) and gapless(got)
    for x in {x.shard for x in got}:
        own = sorted((y for y in got if y.shard == x), key=lambda y: y.slot)
        key = [(y.vslot, y.doc_id is not None, y.doc_id or 0, y.text_crc32, y.size) for y in own]
        assert key == sorted(key)
