import hashlib
import zlib

import pytest

from scenaria.llm import manifest as m
from scenaria.llm.common import table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + fan]) for k in range(0, len(out[-1]), fan)])
    return out


def walk(tree, pos, fan):
    """Siblings of a leaf level by level, left to right, and where it is among them."""
    steps = []
    for level in tree[:-1]:
        run = level[pos // fan * fan : pos // fan * fan + fan]
        steps.append(("".join(run[: pos % fan]), "".join(run[pos % fan + 1 :])))
        pos //= fan
    return steps


def plain(rows, fan=2):
    """The contract, row by row, for rows of FIELDS."""
    leaf = lambda r: H(*map(field, r))
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        by_lang[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = levels([leaf(r) for r in by_lang[name]], fan)
    upper = levels([trees[n][-1][0] for n in names], fan)
    out = []
    for k, name in enumerate(names):
        for pos, r in enumerate(by_lang[name]):
            steps = walk(trees[name], pos, fan) + walk(upper, k, fan)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for left, right in steps:
                h = H(left, h, right)
            root = upper[-1][0]
            out.append((r[0], leaf(r), trees[name][-1][0], root, H(*(a + b for a, b in steps)), h, h == root))
    return sorted(out, key=str)


def found(df, **how):
    chosen = m.F.crc32(m.F.col("doc_id").cast("string")) % 7 == 0
    n_chars = m.F.when(chosen, m.F.col("n_chars") + 1).otherwise(m.F.col("n_chars"))
    rows = m.manifest(df, FIELDS, tampered={"n_chars": n_chars}, **how)
    back = m.folded(m.F.col("checked"), m.F.col("steps"))
    got = rows.select("doc_id", "leaf", "subroot", "root", m.proof_digest(m.F.col("steps")), back.alias("back"), back == m.F.col("root"))
    return sorted(map(tuple, got.collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r[c] for c in FIELDS) for r in docs.collect()]
    got = m.op11_manifest(spark, sf_dir)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("fan,digits", [(2, 2), (3, 2)])
def test_several_tiers_odd_runs_and_nulls(spark, fan, digits):
    rows = [(k, "s", "en", k, f"text {k}") for k in range(53)]
    rows += [(k, None, "de", None, None) for k in range(5)] + [(9, "s", "é", 1, "x"), (9, "s", "z", 1, ""), (70, "s", None, 3, "a:b")]
    rows += [(None, "s", "en", 4, "null id"), (7, "s", "en", 4, "again"), (7, "s", "en", 4, "again"), (7, "s", "en", 4, "again"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df, fan=fan, digits=digits) == plain(rows, fan)
    clash = df.withColumns({c: m.F.lit("x") for c in ("grp", "key", "h", "checked", "rank", "size", "node", "steps", "block", "more", "__at", "__part")})
    assert found(clash, fan=fan, digits=digits) == plain(rows, fan)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 16, 17])
def test_small_groups(spark, n):
    rows = [(k, "s", "en", k, "t") for k in range(n)]
    assert found(spark.createDataFrame(rows, SCHEMA), digits=2) == plain(rows)


def test_empty_table_and_a_long_text(spark):
    rows = [(1, "s", "en", 3, "word " * 1_000_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == plain(rows)
    assert found(df.limit(0)) == []


def test_a_third_of_the_rows_is_one_row(spark):
    """Equal rows are dealt over several ranges, and verify like any other."""
    rows = [(k, "s", "en", k, "t") for k in range(600)] + [(300, "hot", "en", 1, "same")] * 300
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert found(df, digits=4) == plain(rows)
    ranks = m.ranked(df.selectExpr("lang grp", "doc_id key", "text h"), "grp", ["key"], "h")
    assert sorted(r.rank for r in ranks.collect()) == list(range(900))
    parts = df.selectExpr("lang grp", "doc_id key", "text h").filter("h = 'same'")
    assert parts.withColumn("at", m.F.monotonically_increasing_id()).repartitionByRange(4, "key", "h", "at").withColumn("p", m.F.spark_partition_id()).select("p").distinct().count() > 1
