import zlib
from collections import Counter, defaultdict

from ratingspark.llm import sharding


def check_law(rows, got, shards):
    assert len(got) == len(rows) and all(r.law == "rows" and r.grown_shard is None for r in got)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(shards)) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_law_and_groups(docs):
    rows = docs.collect()
    got = sharding.shard(docs).collect()
    check_law(rows, got, 16)
    by_id = {r.doc_id: r for r in got}
    places = defaultdict(set)
    for r in rows:
        assert by_id[r.doc_id].size == len(r.text.encode()) + 1
        assert by_id[r.doc_id].text_crc32 == zlib.crc32(r.text.encode())
        places[r.text].add(by_id[r.doc_id].shard)
    assert all(len(s) == 1 for s in places.values())


def test_hot_group_and_many_small_groups(spark):
    rows = [(k, "hot") for k in range(400)] + [(400 + k, f"pair {k // 2}") for k in range(200)]
    rows += [(1000 + k, f"single {k}") for k in range(600)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_law(rows, got, 16)
    at = {r.doc_id: r.shard for r in got}
    hot = Counter(at[k] for k in range(400))
    assert sum(n for _, n in hot.most_common(8)) >= 350  # spread evenly, eight shards would hold 200
    together = sum(at[400 + 2 * k] == at[401 + 2 * k] for k in range(100))
    assert together >= 95


def test_edge_rows(edge_docs, no_docs):
    got = sharding.shard(edge_docs).collect()
    check_law(range(12), got, 16)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].size == by_id[2].size == 1 and by_id[1].text_crc32 == 0
    assert sharding.shard(no_docs).count() == 0
    check_law(range(12), sharding.shard(edge_docs, shards=1).collect(), 1)


def test_same_shards_for_any_partitions(spark):
    """The shards are a function of the rows, also of repeated ones."""
    rows = [(k, "hot") for k in range(300)] + [(7, "same row")] * 300 + [(None, "no id")] * 20
    rows += [(1000 + k, f"text {k // 3}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = [Counter((r.doc_id, r.text_crc32, r.shard) for r in sharding.shard(df.repartition(n)).collect()) for n in (1, 8)]
    assert placed[0] == placed[1]


def test_what_a_bound_of_rounds_costs(spark):
    """Linked rows apart from their group's largest part, by bound."""
    rows = [(k, f"group {k // 4}") for k in range(800)] + [(1000 + k, f"single {k}") for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def apart(rounds):
        groups = defaultdict(Counter)
        for r in sharding.shard(df, rounds=rounds).collect():
            groups[r.text_crc32][r.shard] += 1
        return sum(sum(g.values()) - max(g.values()) for g in groups.values())
    start, one, settled = apart(0), apart(1), apart(None)
    assert settled <= one < start and settled <= 8
