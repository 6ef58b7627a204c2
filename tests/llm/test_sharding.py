import zlib

from citeloom.llm.sharding import shard_documents


def by_hand(rows, shards):
    items = sorted(((-1, 0) if d is None else (0, d), zlib.crc32((t or "").encode()), len((t or "").encode()) + 16, d) for d, t in rows)
    total, upto, slots, out = sum(i[2] for i in items), 0, {}, []
    for _, crc, size, d in items:
        upto += size
        shard = min(shards - 1, (2 * upto - size) * shards // (2 * total))
        out.append((d, size, crc, "bytes", shard, slots.get(shard, 0), None))
        slots[shard] = slots.get(shard, 0) + 1
    return out


def test_equals_prefix_sums_by_hand(spark, docs):
    rows = [(i, "wörd " * (i * 7 % 23)) for i in range(300)] + [(None, "no id"), (7, None), (7, ""), (9, "x" * 60_000), (5, "same"), (5, "same")]
    got = sorted(map(tuple, shard_documents(docs(rows), 10).collect()), key=repr)
    assert got == sorted(by_hand(rows, 10), key=repr)


def test_sizes_differ_by_one_item_at_most(spark, docs):
    rows = [(i, "a" * (i % 50)) for i in range(1000)]
    sizes = {}
    for r in shard_documents(docs(rows), 8).collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    target = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(s - target) <= 66 for s in sizes.values())


def test_one_key_for_most_rows(spark, docs):
    rows = [(3, "t")] * 200 + [(4, "u")]
    got = shard_documents(docs(rows), 4).collect()
    assert len(got) == 201
    for shard in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) >= 49


def test_empty(spark, docs):
    assert shard_documents(docs([]), 4).collect() == []
