import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest

from strophe.llm import common, merkle, sharding, vector_codes

# ---- sharding ----


@pytest.mark.parametrize("limit", [1, 10**9])
def test_hypergeometric_law(monkeypatch, limit):
    """Against the exact law, by numpy's generator and by halving all the way down."""
    monkeypatch.setattr(sharding, "LARGEST_DRAW", limit)
    good, bad, sample, n = 7, 9, 6, 20_000
    rng = np.random.default_rng(5)
    seen = collections.Counter(sharding.hypergeometric(rng, good, bad, sample) for _ in range(n))
    want = {k: math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample) * n for k in range(sample + 1)}
    assert sum((seen[k] - w) ** 2 / w for k, w in want.items()) < 25 and set(seen) <= set(want)


def test_hypergeometric_of_large_populations():
    rng = np.random.default_rng(1)
    good, bad, sample = 3 * 10**12, 7 * 10**12, 10**12
    draws = [sharding.hypergeometric(rng, good, bad, sample) for _ in range(200)]
    spread = math.sqrt(sample * 0.3 * 0.7 * (good + bad - sample) / (good + bad - 1))
    assert abs(np.mean(draws) - 0.3 * sample) < 5 * spread / math.sqrt(200) and 0.8 < np.std(draws) / spread < 1.2


def test_matrix_has_exact_sums_and_the_law_of_a_shuffle():
    counts, shards = [5, 0, 17, 1, 9, 30, 2], 4
    levels, room = sharding.tree_sums(counts), sharding.even_rooms(sum(counts), 4)
    rows = [[sharding.matrix_row(p, levels, room, seed) for p in range(len(counts))] for seed in range(2000)]
    for m in rows:
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == room
    total, cell = sum(counts), np.array([m[5][0] for m in rows])
    assert abs(cell.mean() - 30 * room[0] / total) < 0.15
    assert abs(cell.var() / (room[0] * 30 / total * (1 - 30 / total) * (total - room[0]) / (total - 1)) - 1) < 0.15
    assert shards == len(room)


def test_shards_are_exact_and_hold_every_row(spark, docs_of, odd_rows, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_CELL", 4)
    docs = docs_of(odd_rows + [(k, "the same text") for k in range(100, 150)]).repartition(5, "doc_id").withColumn("Shard", common.F.lit("own")).withColumn("key", common.F.lit(1))
    docs = common.cut(docs)
    got = sharding.shuffle(docs, 8, 3).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    n = len(odd_rows) + 50
    assert sorted(map(len, slots.values())) == sorted(sharding.even_rooms(n, 8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(str((r.doc_id, r.text, r.key)) for r in got) == sorted(str((r.doc_id, r.text, r.key)) for r in docs.collect())
    again, other = (sorted(map(str, sharding.shuffle(docs, 8, seed).collect())) for seed in (3, 4))
    assert sorted(map(str, got)) == again and again != other
    assert {r.shard for r in sharding.shuffle(docs.limit(3), 8).collect()} == {0, 1, 2}
    assert sharding.shuffle(docs.where("false"), 8).count() == 0


def test_every_place_is_equally_likely(spark):
    docs = common.cut(spark.range(12, numPartitions=3).selectExpr("id AS doc_id", "'t' AS text"))
    at = np.zeros((12, 12))
    for seed in range(12):
        for r in sharding.shuffle(docs, 3, seed).collect():
            at[r.doc_id, r.shard * 4 + r.slot] += 1
    assert ((at - 1) ** 2).sum() < 121 + 5 * math.sqrt(2 * 121)


def test_shuffle_refuses_rows_that_change(spark):
    from pyspark.sql import functions as F

    never_twice = F.udf(lambda: __import__("random").random(), "double").asNondeterministic()
    with pytest.raises(Exception, match="other rows now"):
        sharding.shuffle(spark.range(50).withColumn("x", never_twice()), 4).collect()


def test_written_shards(spark, tmp_path):
    sharding.write_shards(common.cut(spark.range(40, numPartitions=3)), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.id for r in back) == list(range(40)) and sorted((r.shard, r.slot) for r in back) == list(itertools.product(range(4), range(10)))


# ---- Merkle manifest ----


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_over(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def beside(levels, rank):
    """For each level: digests to the left and to the right of the node above ``rank``."""
    for level in levels[:-1]:
        first = rank // 8 * 8
        yield level[first:rank], level[rank + 1 : first + 8]
        rank //= 8


def brute_manifest(rows):
    encode = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    leaf = lambda r: h("".join(map(encode, (r.doc_id, r.source, r.lang, r.n_chars, r.text))))
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = [levels_over([leaf(r) for r in sorted((r for r in rows if r.lang == g), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))]) for g in langs]
    top = levels_over([t[-1][0] for t in trees])
    out = []
    for t, (g, tree) in enumerate(zip(langs, trees, strict=True)):
        for rank, r in enumerate(sorted((r for r in rows if r.lang == g), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))):
            path = [*beside(tree, rank), *beside(top, t)]
            node = leaf(r)
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None:
                node = h("".join(map(encode, (r.doc_id, r.source, r.lang, r.n_chars, r.text.translate(low)))))
            for left, right in path:
                node = h("".join(left) + node + "".join(right))
            out.append((r.doc_id, leaf(r), tree[-1][0], top[-1][0], h("".join(d for left, right in path for d in left + right)), node, node == top[-1][0]))
    return sorted(map(str, out))


@pytest.mark.parametrize("langs", [["en"], [None, "en", "é", "z", "Z", *"abcdef"]])
def test_proofs_equal_brute_force(spark, docs_of, odd_rows, langs):
    from pyspark.sql import functions as F

    rows = odd_rows + [(k, f"Text {k} ÀBC") for k in range(10, 90)] + [(k, "lower") for k in range(90, 99)]
    place = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(len(langs))).cast("int")
    docs = docs_of(rows).withColumn("lang", F.when(F.col("doc_id") == 98, langs[-1]).otherwise(F.array(*map(F.lit, langs))[place])).withColumn("tree", F.lit(1)).withColumn("_at", F.lit("x"))
    got = merkle.check_documents(docs, common.fresh_dir(spark, "manifest")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_manifest(docs.collect())
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 513])
def test_requests_for_some_leaves(spark, n):
    from pyspark.sql import functions as F

    leaves = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    folder = common.fresh_dir(spark, "manifest")
    ranked, made = merkle.build(leaves, F.lit("t"), [F.col("id")], folder)
    asked = spark.createDataFrame([(0, k) for k in {0, n // 2, n - 1, n, n + 8}], "tree long, rank long")
    got = {r["rank"]: r for r in merkle.prove(asked, made).withColumn("s", merkle.siblings(F.col("path"))).collect()}
    levels = levels_over([h(str(k)) for k in range(n)])
    assert set(got) == {0, n // 2, n - 1} and made.root == levels[-1][0]
    for k, r in got.items():
        assert r.s == "".join(d for left, right in beside(levels, k) for d in left + right)
    assert [r.id for r in ranked.orderBy("rank").collect()] == list(range(n))
    if n > 64:
        stored = spark.read.parquet(f"{folder}/trees").collect()
        assert all(h("".join(r.children)) == r.digest for r in stored) and len(stored) == sum(map(len, levels[1:]))


def test_manifest_of_nothing_and_of_one_row_many_times(spark, docs_of):
    assert merkle.check_documents(docs_of([]), common.fresh_dir(spark, "manifest")).count() == 0
    docs = docs_of([(7, "Same")] * 200)
    got = merkle.check_documents(docs, common.fresh_dir(spark, "manifest")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_manifest(docs.collect())


# ---- vector codes ----


@pytest.mark.parametrize("kind", ["wide", "few", "equal", "large"])
def test_nearest_equals_all_distances(kind):
    rng = np.random.default_rng(3)
    draw = {"wide": lambda *s: rng.integers(-300, 300, s), "few": lambda *s: rng.integers(0, 2, s), "equal": lambda *s: np.ones(s, np.int64), "large": lambda *s: rng.integers(-(2**26) + 1, 2**26, s)}[kind]
    parts, number = vector_codes.distinct(draw(700, 7))
    entries = draw(19, 7)
    codes, errors = vector_codes.nearest(parts, entries)
    far = ((parts[:, None, :] - entries) ** 2).sum(axis=2)
    assert (codes == far.argmin(axis=1)).all() and (errors == far.min(axis=1)).all()
    assert len(number) == 700 and len(np.unique(parts, axis=0)) == len(parts)


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max(len(v) for *_, v in kept) // parts)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [(i, label, [(v + [0] * (dims * parts))[p * dims : (p + 1) * dims] for p in range(parts)]) for i, label, v in kept]
    first = kept[:entries]
    books = [[r[2][p] for r in first] for p in range(parts)]
    best = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        near = collections.defaultdict(list)
        for _, _, v in kept:
            for p in range(parts):
                near[p, best(p, v[p])[1]].append(v[p])
        for (p, k), vs in near.items():
            books[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    coded = [(i, label, [best(p, v[p]) for p in range(parts)]) for i, label, v in kept]
    of = collections.Counter()
    for _, label, c in coded:
        of[label] += sum(e for e, _ in c)
    sha = h(",".join(str(x) for b in books for e in b for x in e))
    return sorted(str((i, "".join(f"{k:02x}" for _, k in c), sum(e for e, _ in c), of[label], sha)) for i, label, c in coded)


@pytest.mark.parametrize("block", [50, 65_536])
def test_codes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.normal(size=10) * 0.05], int(k % 3) if k % 5 else None) for k in range(400)]
    rows += [(1, None, 1), (2, [0.1, None], 1), (3, [float("nan")] * 10, 1), (4, [float("inf")], 1), (5, [], 2), (5, [], 2), (None, [0.5] * 9, 0), (-3, [0.25] * 10, None)] + [(700 + k, rows[9][1], 1) for k in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_codes.digest(frame.selectExpr("*", "1 AS codes", "'x' AS whole", "'y' AS both")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_codes(rows)


def test_codes_of_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(3, [0.5, -0.5, 1.0, 2.0], 1), (4, [0.5, -0.5, 1.0, 2.5], 1)], "vec_id long, embedding array<float>, label int")
    out, books = vector_codes.compress(frame)
    assert sorted((r.vec_id, r.codes, r.error) for r in out.collect()) == [(3, [0, 0, 0, 0], 0), (4, [0, 0, 0, 1], 0)]
    back = out.select("embedding", vector_codes.decoded(books, common.F.col("codes")).alias("d")).collect()
    assert all(r.embedding == r.d for r in back)
    assert vector_codes.digest(frame.where("false")).count() == 0 and vector_codes.digest(frame.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(OverflowError):
        vector_codes.compress(spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<float>, label int"))
