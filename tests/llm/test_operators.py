"""Small cases with defined results, and brute force."""

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ann, decontamination, language, license, mixing, near, quality, queries, substring, tokenizer, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h long"
ODD = [(1, None, None, None, None, "k", 1), (2, "", "en", "s", 0, None, None), (3, "word", "en", None, 4, "k", 2), (3, "word", "en", None, 4, "k", 2), (None, "a b c d e f", "fr", "s", 11, "k", 3), (5, "x " * 60_000, "en", "s", 120_000, "k", 4), (6, "é ß — ”quoted“ 漢字 \u0001", "de", "s", 9, "k", 5), (7, "!!! ???", "de", "s", 7, "k", 6)]
LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (2, None, None), (None, 1, 1), (6, 0, 1), (6, 0, 0)], LABELS)
    bench = spark.createDataFrame([(1, "a b c"), (None, "x"), (2, None), (1, "a b c")], "item_id long, text string")
    every = F.lit(True)
    for docs, n in ((odd, len(ODD)), (empty, 0)):
        assert tokenizer.encode_decode(docs).count() == n
        assert quality.score(docs, quality.learn(docs, labels, every)).count() == n
        assert toxicity.score(docs, toxicity.learn(docs, labels, every)).count() == n
        assert mixing.score(docs, *mixing.learn(docs)).count() == n
        assert near.near_classes(docs).count() == n
        assert license.scan(docs).count() == n
        assert substring.substring_dedup(docs).count() == n
        assert language.identify(docs, language.learn_profiles(docs)).count() == n
        assert decontamination.find_phrases(docs, bench).count() == n
        assert decontamination.find_phrases(docs, bench.limit(0)).count() == n


def test_pieces_round_trip_and_library(spark):
    import sentencepiece

    texts = ["", "Hello  world", "naïve 漢字 ▁ \n\n x", " lead", "the quick brown fox " * 50, "\x00\x01 🙂"]
    got = tokenizer.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer.MODEL)
    for r, text in zip(got, texts, strict=True):
        assert r["ids"] == lib.encode(text)
        assert r["decoded"] == text.replace("▁", " ")


def test_near_classes_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(30):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 120))))
        texts.append(words)
        for k in range(int(rng.integers(0, 6))):
            copy = list(words)
            for _ in range(k):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["same few", "Same, few!", "..", "..", None]
    got = {r["doc_id"]: r["class_id"] for r in near.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def shingles(t):
        w = ALNUM.findall(lower(t))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w) or t])

    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) if t is not None else frozenset([i]) for i, t in enumerate(texts)]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert got == {i: root(i) for i in range(len(texts))}


def test_near_classes_of_repeated_passages(spark):
    rng, rows, wanted = np.random.default_rng(6), [], {}
    for i in range(40):
        n, length, repeats = ((300, 80, 20), (300, 80, 50), (300, 80, 200), (40, 20, 200))[i % 4]
        words = [f"d{i}w{k}" for k in rng.permutation(n)]
        part = words[n - length :]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + part * (repeats - 1)))]
        sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows[-2:])]
        wanted |= {2 * i: 2 * i, 2 * i + 1: 2 * i + (len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1]))}
    assert [wanted[2 * i + 1] for i in range(40)] == [2 * i for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == wanted


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(1, 1 << 40, 60).astype(np.uint64)
    wa, wb = rng.random(60) + 0.1, rng.random(60) + 0.1
    wa[:10], wb[50:] = 0, 0
    a, b = wa > 0, wb > 0
    both = np.concatenate([e[a], e[b]])
    doc = np.repeat([0, 1], [a.sum(), b.sum()])
    who = near.prob_minhash(doc, both, np.concatenate([wa[a], wb[b]]), 2, 4096)
    ab = np.flatnonzero(a & b)
    exact = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in ab)
    assert abs((who[0] == who[1]).mean() - exact) < 0.035


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(20, 40)] + [(5, 3), (3, 5), (7, 7)]
    got = {r["node"]: r["component"] for r in near.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 20 for i in range(20, 41)}, 3: 3, 5: 3}


def test_repeated_windows(spark):
    words = [f"w{i}" for i in range(70)]
    texts = [" ".join(words), "x " + "  ".join(words[10:40]) + " y", " ".join(words[:19])]
    got = {r["doc_id"]: r for r in substring.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["n_removed"] for i in range(3)] == [0, 30, 0]
    assert got[1]["kept"] == "x y" and got[2]["kept"] == texts[2]


def test_decontamination_by_brute_force_and_cut(spark):
    item = " ".join(f"t{i}" for i in range(14))
    docs = spark.createDataFrame([(0, "intro, " + item.upper() + " outro"), (1, "t0 t1 t2"), (2, "see Tiny Item, twice: tiny item")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "tiny item")], "item_id long, text string")
    got = {r["doc_id"]: ([tuple(s) for s in r["spans"]], sorted(r["items"])) for r in decontamination.find_phrases(docs, bench).collect()}
    assert got == {0: ([(1, 14)], [1]), 1: ([], []), 2: ([(1, 2), (4, 5)], [2])}
    cut = {r["doc_id"]: r["text"] for r in decontamination.cut_phrases(docs, bench, ["doc_id", "text"]).collect()}
    assert cut[1] == "t0 t1 t2" and cut[0] == "intro,  outro"


@pytest.mark.parametrize("most", [2, decontamination.PHRASES])
def test_decontamination_keeps_every_row(spark, most):
    items = [" ".join(f"{x}{i}" for i in range(12)) for x in "tu"]
    rows = [(None, f"a {items[0]} b"), (None, f"c d {items[1]}"), (None, None), (7, f"{items[0]} {items[1]} e"), (7, "f"), (7, f"g g {items[0]}"), (8, f"h {items[1]}"), (8, f"h {items[1]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = [(r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], list(r["items"])) for r in decontamination.find_phrases(docs, bench, most=most).collect()]
    assert sorted(found, key=str) == sorted([(None, 14, [(1, 12)], [0]), (None, 14, [(2, 13)], [1]), (None, 0, [], []), (7, 25, [(0, 23)], [0, 1]), (7, 1, [], []), (7, 14, [(2, 13)], [0]), (8, 13, [(1, 12)], [1]), (8, 13, [(1, 12)], [1])], key=str)
    cut = [tuple(r) for r in decontamination.cut_phrases(docs, bench, ["doc_id", "text"], most=most).collect()]
    assert sorted(cut, key=str) == sorted([(None, "a  b"), (None, "c d "), (None, None), (7, " e"), (7, "f"), (7, "g g "), (8, "h "), (8, "h ")], key=str)


def test_license_rules_by_brute_force(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3", "all RIGHTS\nreserved; CC-BY cc by", "the MIT License and SPDX-License-Identifier: Apache-2.0", "nothing here", None]
    got = {r["doc_id"]: r for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(6)] == [["cc-by", "cc-by-nc-4.0"], ["gpl", "gpl-3.0"], ["cc-by", "reserved"], ["apache-2.0", "mit"], [], []]
    for i, text in enumerate(texts):
        w, spans = ALNUM.findall(lower(text)), []
        norm = " " + " ".join(w) + " "
        for r in license.rules():
            for m in re.finditer(f"(?<= ){r['pattern']}(?= )", norm):
                first = norm[: m.start()].count(" ") - 1
                spans.append((first, first + m[0].count(" "), r["priority"], r["label"], r["base"]))
        assert sorted(tuple(s) for s in got[i]["spans"]) == sorted(spans)
        assert got[i]["n_words"] == len(w)


def _variants(parsed):
    """What a pattern of the rules can match, each class of characters by its first."""
    kinds, out = re._constants, [""]
    for op, x in parsed:
        if op is kinds.LITERAL:
            ways = [chr(x)]
        elif op is kinds.IN:
            ways = [chr(x[0][1] if x[0][0] is kinds.LITERAL else x[0][1][0])]
        elif op is kinds.SUBPATTERN:
            ways = _variants(x[3])
        elif op is kinds.BRANCH:
            ways = [w for branch in x[1] for w in _variants(branch)]
        else:
            assert op is kinds.MAX_REPEAT
            ways = [w * n for n in {x[0], x[1]} for w in _variants(x[2])]
        out = [a + b for a in out for b in ways]
    return out


def test_license_rules_run_on_all_they_match(spark):
    seen = {}
    for r in license.rules():
        if not r["pattern"].startswith(tuple(lead for lead, _ in license.LEADS if lead)):
            for v in _variants(re._parser.parse(r["pattern"])):
                seen.setdefault(v, set()).add((r["label"], r["priority"], r["base"]))
    texts = sorted(seen)
    got = license.scan(spark.createDataFrame([(i, t.upper()) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for r in got:
        text = texts[r["doc_id"]]
        last = text.count(" ")
        whole = {(s["label"], s["priority"], s["base"]) for s in r["spans"] if (s["first"], s["last"]) == (0, last)}
        assert seen[text] <= whole, text
    for text, label in (("uses GPLv2 here", "gpl-2.0"), ("GPL3", "gpl-3.0"), ("0BSD", "0bsd"), ("zero-clause BSD", "0bsd"), ("under MIT No Attribution", "mit-0"), ("Expat licence", "mit")):
        assert license.scan(spark.createDataFrame([(0, text)], "doc_id long, text string")).first()["labels"] == [label], text


def test_unigram_base_by_brute_force(spark):
    texts = ["the cat the Cat", "a dog\n the end", "", None, "the cat the Cat", " lead  gap  "]
    docs = spark.createDataFrame([*enumerate(texts), (4, "the cat the Cat")], "doc_id long, text string")
    train = docs.filter("doc_id < 2")
    count = {}
    for t in texts[:2]:
        for w in [*WORD.findall(lower(t)), None]:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for r in mixing.score(docs, *mixing.learn(train)).collect():
        words = [*WORD.findall(lower(texts[r["doc_id"]])), None]
        assert r["base_score"] == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in words))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in count for w in words), n)
        assert r["score"] < 0


def test_white_space_of_repeats_is_scored(spark):
    """Of a learned text and its variants that differ in one gap, all variants together are less likely than the text."""
    page = [f"w{i * 7919 % 211}" for i in range(800)]
    train = spark.createDataFrame([(i, " ".join(page)) for i in range(6)], "doc_id long, text string")
    variants = [" ".join(page), " ".join(page[::-1]), " \n\t ".join(page), " ".join(page) + "\n", *(" ".join(page[:k]) + "\n\n" + " ".join(page[k:]) for k in range(100, 700, 3))]
    docs = spark.createDataFrame(enumerate(variants), "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in mixing.score(docs, *mixing.learn(train)).collect()}
    whole = found.pop(0)
    assert whole > found[1] / 3 and found[2] < whole - 800
    assert sum(10.0 ** (x - whole) for x in found.values()) < 1


def test_mixing_is_a_distribution():
    code = mixing.Code(np.bincount(np.frombuffer(b"abracadabra", np.uint8), minlength=256))
    mixer = mixing.Mixer(code, np.zeros((mixing.CONTEXTS, 2 * mixing.SLOTS), np.float32))
    every = np.arange(256, dtype=np.uint8)
    p = mixer.log10(mixing.Symbols(every, np.arange(257)))
    assert 10.0 ** p @ np.ones(256) == pytest.approx(1, abs=1e-4)


def test_mixing_learns_from_all_texts(spark):
    """Which text has which doc_id says nothing: no draw of documents decides what is learned, and all words that came once are learned from."""
    rng = np.random.default_rng(4)
    lists = [[f"{a}{i}" for i in range(40)] for a in ("le", "der", "la", "of")]
    letters = np.array(list("etaoinshrdlu"))
    texts = [" ".join([*rng.choice(lists[d % 4], 20 + d % 7), *("".join(rng.choice(letters[d % 5 :], 3 + d % 6)) for _ in range(8))]) for d in range(1300)]
    models = [mixing.learn(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"))[0] for ids in (range(1300), range(1299, -1, -1))]
    count: dict = {}
    for w in " ".join(texts).split():
        count[w] = count.get(w, 0) + 1
    size = models[0].mixer.code.size
    once = sum(size[[*w.encode(), mixing.END]].sum() for w in count if count[w] == 1)
    assert [m.mixer.learned for m in models] == [once, once]
    for a, b in ((models[0].sizes, models[1].sizes), *((getattr(models[0].mixer, c), getattr(models[1].mixer, c)) for c in ("weights", "gates", "map"))):
        assert a == pytest.approx(b, abs=1e-4)
    assert sorted(models[0].sizes[0]) == sorted(sum(len(t.split()) + 1 for t in texts[k::4]) for k in range(4))


def test_rare_white_space_is_counted(spark, monkeypatch):
    """However little white space is in the broadcast, scores are the same."""
    texts = ["a b  c", " b\ta ", "a\n\n b. c", "", None, "\t", "  c a.\n\n b \t x"]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    found = []
    for most in (mixing.SPACE_KINDS, 1):
        monkeypatch.setattr(mixing, "SPACE_KINDS", most)
        found.append({r["doc_id"]: (r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in mixing.score(docs, *mixing.learn(docs.filter("doc_id < 6"))).collect()})
    assert len(found[0]) == len(texts) and found[0] == found[1]


def test_automaton_finds_one_edit_only():
    trie = toxicity.trie_of(["moron", "idiot", "trash"])

    def edits(w):
        letters = "abcdefghijklmnopqrstuvwxyz"
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}

    for word in edits("moron"):
        assert "moron" in toxicity.edits_within_one(word, trie), word
    for word in ("morn0n", "mroonn", "trsahx", "hello", "mo"):
        assert toxicity.edits_within_one(word, trie) == []


def test_lexicon_hits_every_misspelling():
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = np.random.default_rng(3)
    terms = ["idiot", "stupid", "moron", "trash", "scheißkerl", "imbécil"] + ["".join(rng.choice(list(letters), 9)) for _ in range(200)]
    lexicon = toxicity.Lexicon([(t, 500.0 - i) for i, t in enumerate(terms)])
    for term in [*terms[:6], *terms[-3:]]:
        cuts = [(term[:i], term[i:]) for i in range(len(term) + 1)]
        near = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1} | {a + c + b[1:] for a, b in cuts if b for c in "aqzé"} | {a + c + b for a, b in cuts for c in "aqzé"}
        near = sorted(near - set(terms))
        at, weight, fuzzy = lexicon.hits(toxicity.Read(pa.array([" ".join([*near, "harmless"])]), *lexicon.lengths))
        assert at.tolist() == list(range(len(near))) and fuzzy.all(), term
        assert set(weight) == {500.0 - terms.index(term)}


def test_toxicity_separates_quotation(spark):
    rng = np.random.default_rng(0)
    filler = lambda: " ".join(rng.choice([f"n{i}" for i in range(200)], 30))
    rows = [(i, f"{filler()} you scumbag {filler()}" if i % 4 == 0 else f"{filler()} they said \"scumbag\" {filler()}" if i % 4 == 1 else filler(), int(i % 4 == 0)) for i in range(400)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], 1, r[2]) for r in rows], LABELS)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels, F.lit(True))).collect()}
    assert np.mean([(got[i] >= 0.7) == t for i, _, t in rows]) > 0.97


def test_held_out_quality_and_language(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    q = quality.score(docs, quality.learn(docs, labels, ~held)).join(labels, "doc_id").filter(held)
    assert q.select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("double"))).first()[0] > 0.95
    found = language.identify(docs, language.learn_profiles(docs.filter(~held)), keep=["doc_id", "lang"]).filter(held)
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_neighbours_exact_on_small_tables(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[100:200] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0]), (904, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.neighbours(df, df.filter("vec_id % 50 = 0")).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for q in range(0, 300, 50):
        s = (unit @ unit[q]).round(12)
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:5]
        assert [got[q, k] for k in range(1, 6)] == order
    assert ann.neighbours(df.limit(0), df.limit(0)).count() == 0


def test_pipeline_small(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and all(r["round_trip"] for r in out)


def test_pipeline_stages_on_odd_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline

    item = " ".join(f"t{i}" for i in range(12))
    spark.createDataFrame([(1, item), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    more = [(7, f"a {item} b", "en", "s", 1, None, None), (8, None, "en", "s", 0, None, None), (9, "x " * 60_000 + "z", "en", "s", 9, None, None)]
    hundred = " ".join(f"h{i}" for i in range(100))
    more += [(10, hundred, "en", "s", 10, None, None), (11, hundred[: hundred.rindex(" ")] + " last", "en", "s", 11, None, None)]
    docs = odd.unionByName(spark.createDataFrame(more, DOCS))
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    kept = stages["language_id"](spark, docs, sf)
    assert ids(kept) == sorted([3, 3, None, 5, 6, 7, 9, 10, 11], key=str) and kept.columns == corpus_pipeline.COLUMNS
    assert {r["lang"] for r in kept.filter("doc_id = 3").collect()} == {"en"}
    # the repeated row goes, 11 is 10 but for one word; 5 has one shingle, half of 9's two
    assert ids(stages["near_dedup"](spark, kept, sf)) == sorted([3, None, 5, 6, 7, 9, 10], key=str)
    left = {r["doc_id"]: r["text"] for r in stages["substring_dedup"](spark, docs, sf).collect()}
    # of one word over and over, every window but the first starts earlier too: only its first word is in none of these
    assert left[5] == "x" and left[9] == "z" and left[10] == hundred and left[11] == "last" and left[8] == "" and left[7] == f"a {item} b" and left[None] == "a b c d e f"
    clean = {r["doc_id"]: r["text"] for r in stages["decontamination"](spark, docs, sf).collect()}
    assert clean[7] == "a  b" and clean[8] is None and clean[3] == "word"
    pieces = {r["doc_id"]: (r["n_pieces"], r["round_trip"]) for r in stages["sentencepiece"](spark, docs.filter("doc_id <> 8"), sf).collect()}
    assert pieces[2] == (0, True) and all(ok for _, ok in pieces.values())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.select(corpus_pipeline.COLUMNS), sf).count() == 0


def _folder(tmp_path, spark, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_op6_columns_by_brute_force(spark, tmp_path):
    texts = ["CC BY 4.0; cc-by again", "All rights reserved. GNU General Public License v3 all RIGHTS reserved", "see the MIT License", "", None, "cc bye"]
    d = _folder(tmp_path, spark, documents=([(i, t, "en", "s", 1) for i, t in enumerate(texts)], TEXTS))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for r in queries.op6_licenses(spark, d).collect():
        w = ALNUM.findall(lower(texts[r["doc_id"]]))
        at = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        base = sorted({x for _, x in at})
        assert r["base_labels"] == ",".join(base) and set(base) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and r["labels"].split(",") == sorted(set(r["labels"].split(",")))


def test_op6_suppression_by_brute_force(spark):
    texts = ["Licensed under the Apache License, Version 2.0 and the MIT License", "released under the terms of the GNU General Public License version 2, copyright 2001", "SPDX-License-Identifier: MIT", "CC BY-SA 3.0 unported, cc by"]
    got = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        spans = [s for s in r["spans"] if not s["base"]]
        rank = lambda s: (s["first"], -s["last"], -s["priority"], s["label"])
        held = lambda s, t: t["first"] <= s["first"] and s["last"] <= t["last"] and t["priority"] >= s["priority"] and rank(t) < rank(s)
        want = {s["label"] for s in spans if not any(held(s, t) for t in spans)} | set(r["base_labels"])
        assert set(r["labels"]) == want, r


def test_op3_op8_op2_contract_columns(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    crc = {i: zlib.crc32(str(i).encode()) for (i,) in docs.select("doc_id").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    tox = queries.op3_toxicity(spark, d).collect()
    assert len(tox) == len(crc) and all(r["held_out"] == (crc[r["doc_id"]] % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in tox)
    clean = [r["predicted"] for r in tox if r["held_out"] and r["doc_id"] in labels and not labels[r["doc_id"]]["toxic"]]
    assert np.mean(clean) < 0.03
    lang = queries.op8_language(spark, d).collect()
    known = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(lang) == len(crc) and all(r["held_out"] == (crc[r["doc_id"]] % 4 == 2) and 0 <= r["score"] <= 1 for r in lang)
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in lang if r["held_out"] and r["lang_pred"] != "und"]) > 0.97
    found = queries.op2_quality(spark, d).collect()
    assert len(found) == len(crc) and np.mean([r["keep"] == (labels[r["doc_id"]]["quality"] == 1) for r in found if r["held_out"] and r["doc_id"] in labels]) > 0.85


def test_distances_by_brute_force():
    rng = np.random.default_rng(7)
    places = {lang: {g: k for k, g in enumerate(rng.permutation(60)[:40].tolist())} for lang in ("a", "b")}
    profiles = language.Profiles([{"lang": x, "gram": g, "place": k} for x, p in places.items() for g, k in p.items()], 40)
    counts = [dict(zip(rng.permutation(70)[:30].tolist(), rng.integers(1, 9, 30).tolist(), strict=True)) for _ in range(5)]
    doc, gram, n = (np.array(x) for x in zip(*sorted((d, g, k) for d, c in enumerate(counts) for g, k in c.items()), strict=True))
    got, compared = profiles.distances(5, doc, gram.astype(np.uint64), n)
    for d, c in enumerate(counts):
        ranked = sorted(c, key=lambda g: (-c[g], g))[:40]
        want = [sum(abs(k - places[x][g]) if g in places[x] else 40 for k, g in enumerate(ranked)) for x in ("a", "b")]
        assert got[d].tolist() == want and compared[d] == len(ranked)


class InMemory:
    """A pool of arrays."""

    def __init__(self, text, meta):
        self.views, self.size = (text, meta), len(text)

    def summed(self, function, length):
        return function(*self.views) if self.size else np.zeros(length)


def test_pool_is_summed_by_all_rows(spark):
    """Sums on executors are those of all rows at once, however they are dealt; and what is learned by them is the same."""
    rng = np.random.default_rng(9)
    n, width = 2500, quality.TEXT_FEATURES
    truth = rng.integers(0, 2, n)
    x = np.zeros((n, width + quality.META_FEATURES), np.float32)
    x[:, 3] = truth * 2 - 1 + rng.standard_normal(n)
    x[:, width + 2] = truth * 2 - 1 + rng.standard_normal(n)
    few, rest = slice(0, 200), slice(200, n)
    learned = []
    for parts in (1, 7):
        rows = spark.createDataFrame([(r.tolist(),) for r in x[rest]], "x array<float>").repartition(parts)
        learned.append((x, quality.Pool(rows)))
    learned.append((x, InMemory(x[rest, :width].astype(float), x[rest, width:].astype(float))))
    fitted = [quality.CoTrained().fit(x[few, :width].astype(float), x[few, width:].astype(float), truth[few].astype(float), np.arange(200) % 3 == 0, pool) for x, pool in learned]
    for m in fitted[:2]:
        assert np.allclose(m.text.w, fitted[2].text.w, atol=1e-9) and np.allclose(m.meta.w, fitted[2].meta.w, atol=1e-9)
    # of the rounds' labels each row has at most one from each view, and never one that the other view took before
    free, given = quality.labelled_by(fitted[2].history, *learned[2][1].views)
    assert 0 < (~np.isnan(given)).any(0).sum() == (~free).sum() and fitted[2].used == (~np.isnan(given)).sum()


def test_views_teach_each_other():
    """The labelled rows say nothing in the text view: all it knows comes from the other's labels of the pool."""
    rng = np.random.default_rng(8)
    truth = rng.integers(0, 2, 3000)
    text = (truth[:, None] * 2.0 - 1) * 1.5 + rng.standard_normal((3000, 3))
    text[:300] = 0
    meta = np.column_stack([(truth * 2.0 - 1) * 2 + rng.standard_normal(3000), rng.standard_normal((3000, 3))])
    few, pool, test = slice(0, 300), slice(300, 2000), slice(2000, 3000)
    calibrate = np.arange(300) % 3 == 0
    fit = lambda rows: quality.CoTrained().fit(text[few], meta[few], truth[few].astype(float), calibrate, InMemory(text[rows], meta[rows]))
    right = lambda m: np.mean((m.text.logit(text[test]) > 0) == truth[test])
    assert right(fit(pool)) > 0.95 and right(fit(slice(0, 0))) < 0.6


def test_op4_on_whole_tables(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op4_language_model(spark, d).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count: dict = {}
    for i, t in texts.items():
        for w in [*WORD.findall(lower(t)), None] if not held[i] else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for r in rows:
        words = [*WORD.findall(lower(texts[r["doc_id"]])), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(words), sum(w in count for w in words), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in words), rel=1e-9)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_op10_against_exact_search(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids, unit = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got: dict = {}
    for r in queries.op10_neighbours(spark, d).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        s[q] = -9
        assert all(np.isclose(x, s[ids == i][0]) for i, x in got[ids[q]].items())
        hits += len(set(ids[np.argsort(-s)[:5]].tolist()) & set(got[ids[q]]))
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_neighbours_of_symbols_equal_merging():
    machine = tokenizer.Transducer(tokenizer.MODEL)
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(tokenizer.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    scores = {p.piece: p.score for p in model.pieces if p.type == tokenizer.NORMAL}
    names, rng = list(scores), np.random.default_rng(9)
    pairs = rng.choice(len(names), (4000, 2))
    pairs = pairs[machine.neighbours.whole[pairs].all(1)]
    for (a, b), ok in zip(pairs.tolist(), machine.neighbours.passes(pairs[:, 0], pairs[:, 1]).tolist(), strict=True):
        assert ok == (tokenizer.merged(names[a] + names[b], scores)[0] == [names[a], names[b]])


def test_unigram_paths_by_brute_force():
    from types import SimpleNamespace

    words = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -3.2, "ba": -5.0, "bab": -6.5, "▁ab": -8.0}
    machine = tokenizer.Transducer.__new__(tokenizer.Transducer)
    machine.compile([SimpleNamespace(piece=p, score=s, type=tokenizer.NORMAL) for p, s in words.items()], False, True, 0)
    names = list(words)

    def best(text):
        if not text:
            return 0.0, []
        return min(((c - words[p], [p, *rest]) for p in names if text.startswith(p) for c, rest in [best(text[len(p) :])]), key=lambda x: x[0])

    for text in ("ab", "abab", "babab", "a ab ba", "aaaa bbbb"):
        ids, bounds = machine.encode([text])
        want = sum(best(s)[0] for s in machine.cut.findall(machine.normalised(text)))
        assert sum(-words[names[i]] for i in ids[bounds[0] : bounds[1]]) == pytest.approx(want)


def test_near_group_of_many_copies_loses_no_link(spark):
    """Copies of copies of one text, most of them too far from each other: every link is found."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(80)]
    texts = [base]
    for _ in range(250):
        words = list(texts[int(rng.integers(len(texts)))] if rng.random() < 0.3 else base)
        for _ in range(int(rng.integers(1, 5))):
            words[int(rng.integers(len(words)))] = f"v{int(rng.integers(40))}"
        texts.append(words)
    texts += [base[:k] for k in range(40, 80, 3)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near.near_classes(docs).collect()} == {i: root(i) for i in range(len(texts))}


def test_rows_of_one_doc_id_lose_their_own_words(spark):
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(30)]
    rows = [(2, " ".join(a)), (2, " ".join(b)), (1, " ".join(a[:25])), (3, " ".join(b + a)), (3, " ".join(b + a)), (None, " ".join(a))]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 25, 0), ("2", 30, 0), ("2", 40, 25), ("3", 70, 70), ("3", 70, 70), ("None", 40, 0)]
