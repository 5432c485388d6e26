"""Quality rules as a bitmask ledger, with DataFrame expressions only.

`ledger` measures each text once and evaluates each rule once: bit i of `failed` is set
if rule i fails. A policy is a versioned set of rules; `apply_policy` is one bitwise
AND per row. `ablations` counts rows by failure mask first (at most 2**rules groups,
combined map-side) and derives from those what each rule decides alone.

Measurements of a text: n_words; word_chars (code points in words); n_symbols
(characters of `[#*$%&|<>]`); n_dup_lines (lines with a word that equal an earlier
line); n_repeat_words (words in 3-word windows that occur twice or more in the text, the
first included). Windows are told apart by their words' 64-bit xxhash.

Defined cases: a null or blank text has no words, measures 0 throughout and fails the
rule on length; repeated rows are judged each by itself; texts of any length are
measured whole, in time n log n; an empty table gives no rows; other columns pass
through, and those named like a new column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, col

#: Rule i, at bit i: (name, SQL condition under which a text fails).
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_words", "n_words > 1000000"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines > 0 AND 100 * n_dup_lines > 50 * n_lines"),
)
BASE = ("few_words", "repeated_words")
#: Policies by version; a row is kept if none of its policy's rules fails.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "strict-1": tuple(name for name, _ in RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(rules: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bits[name] for name in rules)


def _repeat_words() -> list[tuple[str, Column]]:
    """Steps that count the words covered by repeated 3-word windows; `words` exists."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    hashes = F.when(F.size("words") >= 3, windows).otherwise(F.array().cast("array<bigint>"))
    repeats = F.size("hashes") > F.size(F.array_distinct("hashes"))
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # a window repeats if a neighbour in hash order equals it
    ahead = F.concat(F.slice(F.col("placed"), 2, F.size("placed")), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    behind = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(F.col("placed"), 1, F.size("placed") - 1))
    marked = F.zip_with(
        F.zip_with("placed", ahead, lambda x, y: F.struct(x["i"].alias("i"), x["h"].alias("h"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("same"))),
        behind,
        lambda x, y: F.when(x["same"] | F.coalesce(x["h"] == y["h"], F.lit(False)), x["i"]),
    )
    starts = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
    # each window adds the words up to the next one's start, three at most
    gaps = F.zip_with("starts", F.slice("starts", 2, F.size("starts")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g)
    none = F.array().cast("array<int>")
    return [
        ("hashes", hashes),
        ("repeats", repeats),
        ("placed", F.when(F.col("repeats"), placed)),
        ("starts", F.when(F.col("repeats"), starts).otherwise(none)),
        ("n_repeat_words", covered),
    ]


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of MEASURES, all long."""
    new = {*MEASURES}
    kept = [c for c in df.columns if c.lower() not in new]
    whole = F.coalesce(col(text), F.lit(""))
    out = df.select(F.struct(*[col(c) for c in kept]).alias("row"), whole.alias("text"))
    out = out.withColumn("words", F.filter(F.split("text", f"[{BLANKS}]+", -1), lambda w: w != ""))
    out = out.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]")))
    out = out.select(
        "row",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", "[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    for name, step in _repeat_words():
        out = out.withColumn(name, step)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *MEASURES)


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its measurements and `failed`, the bits of the rules that fail."""
    measured = measure(df.drop("failed"), text)
    bits = [F.when(F.expr(fails), F.lit(1 << i)).otherwise(0) for i, (_, fails) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    # a filter on `failed` must not be pushed below the measuring steps: Catalyst would
    # repeat each of them wherever the next one refers to it. It stops at this id, which adds 0.
    return measured.withColumn("failed", failed.bitwiseOR(F.spark_partition_id() * 0).cast("long"))


def apply_policy(ledger_rows: DataFrame, version: str) -> DataFrame:
    """The ledger with `kept` by the policy of that version."""
    return ledger_rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(ledger_rows: DataFrame, version: str) -> DataFrame:
    """Per rule of the policy: rows it fails, and rows that only it rejects."""
    policy = mask(POLICIES[version])
    spark = ledger_rows.sparkSession
    masks = ledger_rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    named = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask((name,))).alias("bit")) for name in POLICIES[version]])
    per = masks.select("failed", "n", F.explode(named).alias("r"))
    fails = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("failed").bitwiseAND(F.lit(policy)) == F.col("r.bit")
    counted = per.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("fails"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only_this"))
    rules = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in POLICIES[version]])).alias("rule"))
    return rules.join(counted, "rule", "left").fillna(0, ["fails", "only_this"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdicts on all documents, by the strict policy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = apply_policy(ledger(docs), "strict-1")
    base_failed = (F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0).alias("base_failed")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed, "kept", "failed")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) >= 3
), g3 AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM g
), r AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM g3, (VALUES (0), (1), (2)) AS o(k) WHERE n >= 2 GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (rid)
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END
    + CASE WHEN n_symbols > n_words THEN 32 ELSE 0 END
    + CASE WHEN n_dup_lines > 0 AND 100 * n_dup_lines > 50 * n_lines THEN 64 ELSE 0 END)::BIGINT AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
