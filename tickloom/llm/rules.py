"""Quality rules as a ledger of bits, in DataFrame and SQL functions only.

* `ledger` measures every text once, evaluates every rule once on the measurements and keeps both: a column for each
  measurement, and `failed`, whose bit i says that rule i failed. Bit numbers are for good: rules are only appended.
* A policy is a version's set of rules, so a mask: a document is kept if `failed & mask` is 0 (`apply_policy`). Another
  policy, or another version of one, needs no text and no rule again.
* `ablations` groups documents by their bits (a partial count in each task; as many groups as there are different sets
  of failures) and reads from the groups what each rule of a policy drops, drops alone, and would give back if left out.
  `footprint` says by any column which rules failed somewhere (bit_or) and everywhere (bit_and).

Words are [^\\x20\\x09-\\x0D]+. Repeated windows of three words are found in one text's own arrays: windows are hashed,
hash and place share a number, the numbers are sorted, and only windows whose hash has a neighbour are compared, by
their words. Nothing leaves the row, so a frequent window or line is no key of anything.

Cases: a null or empty text has no words, all of its measurements are 0, and it fails `few_words` alone. Each row gives
one row, repeated or not; rows without doc_id too. An empty table gives none. Of the table's other columns only `keep`
come along; one of these that has the name of a measurement raises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
#: The characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: What begins a list's line, and what ends a cut one.
BULLETS, ELLIPSES = ("-", "*", "•", "▪"), ("...", "…")

#: What is measured, in order; all are whole numbers.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_cut_lines", "n_repeat_words", "n_letterless", "n_fillers")

#: Rule i, its name and when it fails: SQL over the measurements, whole numbers only. Never reorder: a rule's place is its bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("list_lines", "10 * n_bullet_lines > 9 * n_lines"),
    ("cut_lines", "10 * n_cut_lines > 3 * n_lines"),
    ("few_letters", "10 * n_letterless > 4 * n_words"),
    ("filler", "n_fillers > 0"),
    ("many_words", "n_words > 100000"),
    ("some_symbols", "50 * n_symbols > n_words"),
    ("some_repeated_windows", "100 * n_repeat_words > 20 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum({BIT[n] for n in names})


#: What the contract of every policy has.
BASE = mask_of("few_words", "repeated_windows")
#: Versions, oldest first; a version that was used is not changed, a new one is added.
POLICIES: dict[str, int] = {
    "base-1": BASE,
    "default-1": BASE | mask_of("many_symbols", "repeated_lines", "short_words", "long_words", "list_lines", "cut_lines", "few_letters", "filler"),
    "strict-1": BASE | mask_of("many_symbols", "repeated_lines", "short_words", "long_words", "list_lines", "cut_lines", "few_letters", "filler", "many_words", "some_symbols", "some_repeated_windows"),
}
PRODUCTION = "default-1"

#: Words in windows found twice or more, from w (the words), by steps that each need the one before as a column.
_REPEATS = (
    # places take so many low bits, the rest is the hash's
    ("_b", "CAST(ceil(log2(greatest(size(_w), 2))) AS int)"),
    # the last two places have shorter windows, which are let go when words are compared
    ("_s", "sort_array(transform(_w, (x, i) -> shiftleft(xxhash64(x, get(_w, i + 1), get(_w, i + 2)), _b) | CAST(i AS bigint)))"),
    # a window whose hash has a neighbour in order: next to it, or the one before
    ("_n", "filter(_s, (x, i) -> (i > 0 AND shiftright(x, _b) = shiftright(_s[i - 1], _b)) OR (i + 1 < size(_s) AND shiftright(x, _b) = shiftright(_s[i + 1], _b)))"),
    ("_t", "CASE WHEN size(_n) = 0 THEN array() ELSE sort_array(transform(filter(transform(_n, x -> CAST(x & (shiftleft(1L, _b) - 1) AS int)), p -> p < size(_w) - 2), p -> struct(_w[p] AS a, _w[p + 1] AS b, _w[p + 2] AS c, p AS p))) END"),
    ("_p", "sort_array(transform(filter(_t, (x, i) -> (i > 0 AND x.a = _t[i - 1].a AND x.b = _t[i - 1].b AND x.c = _t[i - 1].c) OR (i + 1 < size(_t) AND x.a = _t[i + 1].a AND x.b = _t[i + 1].b AND x.c = _t[i + 1].c)), x -> x.p))"),
    ("n_repeat_words", "aggregate(_p, named_struct('end', 0, 'n', 0L), (s, p) -> named_struct('end', p + 3, 'n', s.n + p + 3 - greatest(s.end, p)), s -> s.n)"),
)


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep and the measurements of each row's text."""
    clash = set(keep) & ({"failed"} | set(MEASURES))
    if clash:
        raise ValueError(f"columns with names of measurements: {sorted(clash)}")
    # keep columns travel under names of their own: a table may have columns like the ones worked with here
    x = docs.select(*(F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    x = x.withColumn("_w", F.array_remove(F.split("_text", BLANKS), ""))
    x = x.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)))
    begins = lambda line: reduce(Column.__or__, (F.ltrim(line).startswith(b) for b in BULLETS))
    ends = lambda line: reduce(Column.__or__, (F.rtrim(line).endswith(e) for e in ELLIPSES))
    x = x.select(
        *(f"_keep{i}" for i in range(len(keep))),
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("_text", SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_lines", begins)).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_lines", ends)).cast("long").alias("n_cut_lines"),
        F.size(F.filter("_w", lambda w: ~w.rlike(r"\p{L}"))).cast("long").alias("n_letterless"),
        F.contains(F.lower("_text"), F.lit("lorem ipsum")).cast("long").alias("n_fillers"),
    )
    for name, sql in _REPEATS:
        x = x.withColumn(name, F.expr(sql))
    return x.select(*(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), *MEASURES)


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (doc_id, unless told), the measurements, and failed: bit i is set if rule i failed."""
    keep = ["doc_id"] if keep is None else keep
    x = measured(docs, keep)
    bits = [F.when(F.expr(sql), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (_, sql) in enumerate(RULES)]
    x = x.withColumn("failed", reduce(Column.bitwiseOR, bits))
    # a generated row: filters on the ledger stay above it, so that what they ask for isn't written out and worked out again
    return x.select(*(F.col(f"`{c}`") for c in keep), F.inline(F.array(F.struct(*MEASURES, "failed"))))


def passes(mask: int) -> Column:
    """Whether none of the mask's rules failed."""
    return F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """A ledger's rows with policy and kept."""
    return rows.withColumn("policy", F.lit(policy)).withColumn("kept", passes(POLICIES[policy]))


def names_of(failed: Column, mask: int = (1 << len(RULES)) - 1) -> Column:
    """The names of the rules of a mask that failed, in order of bits."""
    every = F.array(*(F.when(failed.bitwiseAND(F.lit(mask & (1 << i)).cast("long")) != 0, F.lit(n)) for i, (n, _) in enumerate(RULES)))
    return F.filter(every, lambda n: n.isNotNull())


def ablations(rows: DataFrame, *policies: str) -> DataFrame:
    """policy, rule, and counts of documents: all, dropped by the policy, failed by the rule, dropped by it alone (so given
    back without it), kept without it. Policies: all, unless told."""
    groups = rows.groupBy("failed").agg(F.count("*").alias("n"))
    cells = [(p, n, POLICIES[p], BIT[n]) for p in policies or POLICIES for n, _ in RULES if POLICIES[p] & BIT[n]]
    listed = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(n).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, n, m, b in cells))
    x = groups.select("failed", "n", F.explode(listed).alias("c")).select("failed", "n", "c.*").withColumn("hit", F.expr("failed & mask"))
    total = lambda condition: F.coalesce(F.sum(F.when(F.expr(condition), F.col("n"))), F.lit(0)).alias
    return x.groupBy("policy", "rule").agg(total("true")("n_docs"), total("hit <> 0")("n_dropped"), total("(hit & bit) <> 0")("n_failed"), total("hit = bit")("n_alone"), total("(hit & ~bit) = 0")("n_kept_without"))


def footprint(rows: DataFrame, *by: str) -> DataFrame:
    """For each value of the columns: documents, some_failed and all_failed (bits of the rules that failed in some, in all)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_docs"), F.bit_or("failed").alias("some_failed"), F.bit_and("failed").alias("all_failed"))
