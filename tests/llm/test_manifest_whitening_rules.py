"""Merkle manifest, whitening and quality rules: brute force, odd inputs, interfaces."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import merkle, queries, rules, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx long, digest string, failed long, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(doc_id, source, lang, n_chars, text):
    return H(*map(told, (doc_id, source, lang, n_chars, text)))


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way_of(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((run[: i % 16], run[i % 16 + 1 :]))
        i //= 16
    return out


def manifest_of(rows):
    """rows: doc_id, source, lang, n_chars, text. A Counter of the query's rows."""
    by = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        leaf = leaf_of(doc_id, source, lang, n_chars, text)
        forge = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        by[source].append((doc_id is not None, doc_id or 0, leaf, leaf_of(doc_id, source, lang, n_chars, lower(text)) if forge else leaf, doc_id))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(by[s])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = Counter()
    for place, s in enumerate(order):
        for i, (_, _, leaf, forged, doc_id) in enumerate(sorted(by[s])):
            way = way_of(trees[s], i) + way_of(top, place)
            folded = forged
            for left, right in way:
                folded = H(*left, folded, *right)
            out[doc_id, leaf, trees[s][-1][0], top[-1][0], H(*(x for left, right in way for x in [*left, *right])), folded, folded == top[-1][0]] += 1
    return out


def documents(spark, tmp_path, rows):
    spark.createDataFrame([(d, t, lang, s, n, "x", 1, "y", 2, "z") for d, s, lang, n, t in rows], DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest_rows(spark, folder):
    return Counter(tuple(r) for r in queries.op11_merkle_manifest(spark, folder).select(*COLUMNS).collect())


def test_manifest_by_brute_force(spark, tmp_path):
    # a hot source over several runs and levels, many sources of few, repeated rows, null and repeated ids, null source and ''
    rows = [(i, "hot", "en", i, f"Text {i} É") for i in range(600)] + [(i % 40, f"s{i % 37}", None, None, None if i % 5 == 0 else f"A{i}") for i in range(150)]
    rows += [(7, "dup", "de", 1, "Same")] * 3 + [(None, "dup", "de", 1, "Null Id"), (None, None, None, None, None), (5, None, "fr", 0, ""), (5, "", "fr", 0, ""), (1, "É", "fr", 0, "Ü"), (-3, "zz", "en", 1, "NEG")]
    rows += [(i, "seventeen", "en", 1, "Q") for i in range(17)] + [(i, "sixteen", "en", 1, "Q") for i in range(16)]
    got = manifest_rows(spark, documents(spark, tmp_path, rows))
    assert got == manifest_of(rows)
    assert {v for *_, v in got} == {True, False}


def test_manifest_of_one_row_one_source_and_none(spark, tmp_path):
    for i, rows in enumerate(([], [(1, None, None, None, None)], [(5, "a", "en", 1, "X"), (6, "b", "en", 1, "Y")], [(i, "a", "en", 1, "X" * 3_000_000 if i == 3 else "y") for i in range(40)])):
        (tmp_path / str(i)).mkdir()
        assert manifest_rows(spark, documents(spark, tmp_path / str(i), rows)) == manifest_of(rows)


def test_coordinates_go_on_over_runs(spark):
    n = 1000
    x = spark.range(n).select(F.when(F.col("id") < 900, "a").otherwise(F.concat(F.lit("b"), (F.col("id") % 3).cast("string"))).alias("tree"), F.col("id").alias("k"))
    placed, runs = merkle.coordinates(x, "k")
    by = defaultdict(list)
    for r in placed.collect():
        by[r["tree"]].append((r["idx"], r["k"]))
    assert all([i for i, _ in sorted(v)] == list(range(len(v))) and sorted(v) == sorted(v, key=lambda p: p[1]) for v in by.values())
    assert runs.filter("tree = 'a'").select("run").distinct().count() > 1


def test_store_keeps_levels_and_folds_single_proofs(spark, tmp_path):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(300)]
    out = merkle.manifest(spark.read.parquet(documents(spark, tmp_path, rows) + "/documents.parquet"))
    r = out.filter("doc_id = 123").select("leaf", "root", merkle.folded(F.col("leaf"), F.col("way")).alias("same"), merkle.folded(F.lit("0" * 64), F.col("way")).alias("other"), F.size("way").alias("steps")).first()
    assert r["same"] == r["root"] != r["other"] and r["steps"] == 3


EMBEDDINGS = "vec_id long, embedding array<float>, x array<int>, key string"


def whitening_of(vectors, most=16):
    """n, deviations and whitened values of the rows that take part, by whole numbers and one eigh."""
    ok = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in ok]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    s = [sum(r[j] for r in fit) for j in range(d)]
    centre = lambda rows: np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in rows])
    f = centre(fit)
    e, u = np.linalg.eigh(f.T @ f / n)
    o = np.argsort(-e)[:most]
    return [i for i, _ in ok], n, [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x], centre(x) @ u[:, o] / np.sqrt(e[o]), e[o] / e.sum()


def embeddings(spark, tmp_path, vectors):
    spark.createDataFrame([(i, v, [1], "k") for i, v in vectors], EMBEDDINGS).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_whitening_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 20)).astype(np.float32) @ rng.normal(size=(20, 20)).astype(np.float32)
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    # a third of the rows are copies, others take no part
    vectors += [(1000 + i, vectors[7][1]) for i in range(150)] + [(2000, None), (2001, []), (2002, [None] + [1.0] * 19), (2003, [math.nan] * 20), (2004, [math.inf] + [0.0] * 19)]
    got = queries.op12_whitening(spark, embeddings(spark, tmp_path, vectors)).toPandas()
    ids, n, deviation, white, explained = whitening_of(vectors)
    assert len(got) == 16 * len(ids) == 16 * 450 and n == 300 and set(got.n) == {300}
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((w * white).sum(0))
    assert np.abs(w * sign - white).max() < 1e-9
    first = got[got.component == 1].set_index("vec_id")
    assert [int(first.deviation[i]) for i in ids] == deviation
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_of_large_and_flat_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    run = lambda rows: whitening.whitened(spark.createDataFrame(rows, schema)).toPandas()
    # sums and products far beyond doubles and longs; the others' length is commoner
    big = [(1, [2.0**50, 1.0]), (2, [-(2.0**50), 2.0]), (3, [2.0**40, 3.5]), (4, [2.0**40, 3.5]), (5, [1.0]), (6, [2.0**60, 0.0])]
    got = run(big)
    assert set(got.vec_id) == {1, 2, 3, 4} and set(got.n) == {3} and got.deviation.isna().all()
    assert got.identity_error.max() < 1e-6
    # one distinct vector, and one row: no variance
    for rows in ([(1, [1.0, 2.0])] * 3, [(None, [3.0])]):
        flat = run(rows)
        assert flat.whitened.isna().all() and (flat.explained == 0).all() and flat.identity_error.isna().all() and (flat.deviation == 0).all()
    # a constant dimension and two that depend on each other
    rng = np.random.default_rng(2)
    got = run([(i, [float(a), 2 * float(a), 5.0, float(b)]) for i, (a, b) in enumerate(rng.integers(-50, 50, (80, 2)))])
    assert got.groupby("component").whitened.count().tolist() == [80, 80, 0, 0] and got.identity_error.max() < 1e-9
    assert len(run([(1, None)])) == 0 and len(run([])) == 0


def test_scatter_is_exact_by_any_shift(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 61), 1 << 61, (50, 3))
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>")
    o = x.astype(object)
    s = o.sum(0)
    want = (50 * (o.T @ o) - np.outer(s, s)).tolist()
    for shift in (0, 1_000_000, -17):
        n, sums, c = whitening.scatter(df, shift)
        assert n == 50 and sums == s.tolist() and c == want
    small = rng.integers(-1000, 1000, (5000, 4))
    assert (whitening.products(small)[:4, :4] == small.T @ small).all()
    assert all(sum(p << (whitening.LIMB * k) for k, p in enumerate(parts)) == v for v in (0, -1, 1 << 150, -(1 << 150) + 12345) for parts in whitening.limbs([v]))


def base_of(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {k for k, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, k in enumerate(windows) if k in often for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a a", "# $ % <&>|* 🙂 漢字 é", "x\ny\nx\n\n \nx\r", "- a\n- b\n* c", "\x0b a\x0cb c 　 d", "one two three " * 40_000]
    texts += [" ".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(1, 400, 60)] + ["\n".join(rng.choice(["x y z", "p q", "r s t u"], 30))] + [" ".join(f"w{i}" for i in range(70_000))]
    folder = documents(spark, tmp_path, [(i, "s", "en", 1, t) for i, t in enumerate(texts)] + [(0, "s", "en", 1, "again"), (None, "s", "en", 1, "no id")])
    got = queries.op13_quality_rules(spark, folder).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r["doc_id"] is not None and (r["doc_id"] or r["n_words"] == 0):
            want = base_of(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])
    assert any(r["kept"] for r in got)


def test_ledger_policies_and_ablations(spark):
    clean = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, clean), (2, "too few"), (3, clean + " #" * 30), (4, "lorem ipsum"), (5, clean + " lorem ipsum"), (6, " ".join(["1"] * 30 + [clean] + [str(i) for i in range(90)])), (7, clean + " & & &"), (8, clean)]
    led = rules.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    names = {r["doc_id"]: r["f"] for r in led.select("doc_id", rules.names_of(F.col("failed")).alias("f")).collect()}
    assert names[1] == names[8] == [] and names[2] == ["few_words"] and names[4] == ["few_words", "filler"] and names[5] == ["filler"] and names[3][:2] == ["many_symbols", "some_symbols"] and "few_letters" in names[6] and names[7] == ["some_symbols"]
    kept = lambda p: {r["doc_id"] for r in rules.apply_policy(led, p).filter("kept").collect()}
    assert kept("base-1") >= kept("default-1") >= kept("strict-1") == {1, 8} and 7 in kept("default-1")
    table = {(r["policy"], r["rule"]): r for r in rules.ablations(led).collect()}
    failed = {r["doc_id"]: r["failed"] for r in led.collect()}
    for (p, n), r in table.items():
        m, b = rules.POLICIES[p], rules.BIT[n]
        assert r["n_docs"] == 8 and r["n_dropped"] == sum(v & m != 0 for v in failed.values()) and r["n_failed"] == sum(v & b != 0 for v in failed.values())
        assert r["n_alone"] == sum(v & m == b for v in failed.values()) and r["n_kept_without"] == sum(v & m & ~b == 0 for v in failed.values())
    assert {n for _, n in table} == {n for n, _ in rules.RULES}
    f = rules.footprint(led).first()
    assert f["all_failed"] == 0 and f["some_failed"] & rules.BIT["filler"] and f["n_docs"] == 8
    assert rules.ablations(led.limit(0)).count() == 0 and rules.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert len({b for b in rules.BIT.values()}) == len(rules.RULES)
    with pytest.raises(ValueError, match="n_words"):
        rules.ledger(spark.createDataFrame([(1, "a")], "n_words long, text string"), ["n_words"])
