"""Near-duplicate documents by a signature-coordinate inverted join.

1. Each text becomes its set of word shingles, and the set a signature of `COORDS`
   minima. Texts with equal sets are one class from here on (combined map-side).
2. Classes are posted under each (coordinate, value) of their signature. Two signatures
   that agree in `MATCHES` of `COORDS` coordinates share one of the first
   COORDS - MATCHES + 1 postings of each, in any common order; taking the rarest
   postings first keeps lists of frequent shingles short. Values posted once
   find nobody and are dropped.
3. In each list every class is paired with the class whose values are shared most widely, as
   an original's are; a class keeps the partner with most collisions. Pairs whose signatures
   agree often enough are confirmed on their full shingle sets. Confirmed links make components.
4. Merging skips what is linked already, in rounds. Each list that still holds several
   components puts up leaders; a leader is compared with the list's classes in other components,
   and then leaves the list, as all of its pairs there are settled. Components are contracted between
   the rounds, so a group of n near copies costs about n pairs a round.
5. Lists that are open after that round over signatures come from texts that share much, but less than the
   threshold. Their classes are posted again, under the rarest shingles of their full sets and by
   set size (see `_full_posts`): this is exact, and leaves out classes that can't reach the
   threshold with anybody. Rounds go on over these lists, with GROWTH times as many leaders in each,
   until none is open. So every pair is linked through others, or compared once, or excluded by a bound.

A pair at the threshold of 0.8 agrees in fewer than MATCHES coordinates with
probability 8e-7 (binomial with 48 coordinates, taking their hashes as independent); nothing
else is approximate, save for 64-bit hashes of shingles and 128-bit sums of them for whole sets.

Defined cases: a null, empty or blank text has no shingles and is linked with nothing;
a text with fewer words than the shingle has its whole sequence as one; repeated rows
are kept as rows, of one class; a null doc_id never names a component if the
component has another id, otherwise component_id is null and kept true; rows that share a doc_id
but not the text are judged apart; an empty table gives no rows; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import as_table, col
from .graph import contract
from .tokens import U64, mix64, pieces, shingles, word_hashes

COORDS = 48
MATCHES = 24
PREFIX = COORDS - MATCHES + 1
#: Leaders of each open list: in the round over signatures, in the first over full sets, and how they multiply.
LEADERS, FULL_LEADERS, GROWTH = 1, 64, 1024
#: A link needs 100 * common >= THRESHOLD * union.
THRESHOLD = 80

_ODD = mix64(np.arange(1, COORDS + 1, dtype=U64)) | U64(1)


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in pieces(texts):
        words, counts = word_hashes(data, offsets)
        grams, n = shingles(words, counts, width)
        end = np.cumsum(n)
        for a, b in zip(end - n, end):
            s = np.sort(grams[a:b])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2)
            sizes, keys, sigs, group = [], [], [], []

            def flush() -> None:
                """Signatures of the sets gathered in `group`."""
                if not group:
                    return
                full = [s for s in group if len(s)]
                out = np.zeros((len(group), COORDS), dtype=np.int32)
                sums = np.zeros((len(group), 2), dtype=U64)
                if full:
                    flat = np.concatenate(full)
                    at = np.cumsum([0] + [len(s) for s in full[:-1]])
                    rows = np.flatnonzero([len(s) > 0 for s in group])
                    for k in range(COORDS):
                        least = np.minimum.reduceat(flat * _ODD[k], at)
                        out[rows, k] = (least >> U64(20)).astype(np.uint32).view(np.int32) ^ (least >> U64(44)).astype(np.int32)
                    sums[rows, 0] = np.add.reduceat(mix64(flat), at)
                    sums[rows, 1] = np.add.reduceat(mix64(flat ^ U64(0x5851F42D4C957F2D)), at)
                sizes.extend(len(s) for s in group)
                keys.extend(x.tobytes() for x in sums)
                sigs.append(out)
                group.clear()

            held = 0
            for s in _sets(texts, width):
                group.append(s)
                held += len(s) + 16
                if held > 200_000:
                    flush()
                    held = 0
            flush()
            flat = np.concatenate(sigs).reshape(-1) if sigs else np.zeros(0, np.int32)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * COORDS, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), sig], names=["doc_id", "text_hash", "n_shingles", "set_key", "sig"])

    return run


def _confirm(width: int, threshold: int):
    """Keeps the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            keys_a, keys_b = batch.column(names.index("a")), batch.column(names.index("b"))
            kept = []
            last_key, last_set = None, None
            texts_a, texts_b = batch.column(names.index("text_a")), batch.column(names.index("text_b"))
            for i, (ka, sb) in enumerate(zip(keys_a.to_pylist(), _sets(texts_b, width))):
                if ka != last_key:
                    last_key, last_set = ka, next(_sets(texts_a.slice(i, 1), width))
                common = len(np.intersect1d(last_set, sb, assume_unique=True))
                kept.append(100 * common >= threshold * (len(last_set) + len(sb) - common) and common > 0)
            chosen = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([keys_a.filter(chosen), keys_b.filter(chosen)], names=["a", "b"])

    return run


def _grams(width: int):
    """Exploded shingle sets: (node, size, gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, held, rows, sets = np.asarray(batch.column(0)), 0, [], []
            for i, grams in enumerate(_sets(batch.column(1), width)):
                rows.append(i)
                sets.append(grams)
                held += len(grams)
                if held >= 1 << 18 or i == len(batch) - 1:
                    n = np.array([len(s) for s in sets])
                    cols = [np.repeat(node[rows], n), np.repeat(n, n), np.concatenate(sets).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "size", "gram"])
                    held, rows, sets = 0, [], []

    return run


def _shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and is not to be broadcast, however small Spark takes it for.

    It takes what explode makes of a row for one row, and compressed files for what they hold; just below
    its threshold, millions of rows would pass through the driver.
    """
    return side.hint("merge")


def _full_posts(nodes: DataFrame, bodies: DataFrame, width: int, threshold: int) -> DataFrame:
    """Postings of full sets, whose lists hold every pair that may reach the threshold.

    Shingles are ordered rare first. Two sets at the threshold have at least
    threshold * (n_a + n_b) / (100 + threshold) shingles in common, so the first common one is early in
    both, and what follows it in each must still suffice. A list is a shingle and a class of the smaller
    set's size (5 % wide); a set is posted as the smaller one in the class of its own size, and as
    the larger one in those that its posting's place still allows.
    """
    texts = bodies.join(nodes, "node", "left_semi").select("node", "text")
    grams = as_table(texts.mapInArrow(_grams(width), "node long, size long, gram long"), "minhash-grams")
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    mine = Window.partitionBy("node")
    # shingles of one text only come first in the order
    place = F.col("size") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("often", "gram"))
    posts = grams.join(_shuffled(often), "gram").withColumn("place", place)
    # what can be common from here on, and the other's largest size that this allows
    posts = posts.withColumn("most", F.floor((F.col("size") - F.col("place") + 1) * ((100 + threshold) / threshold)) - F.col("size"))
    step = lambda c: F.floor(F.log(c.cast("double")) / np.log(1.05)).cast("int")
    least = F.ceil(F.col("size") * (threshold / 100))
    own = F.when(F.col("most") >= F.col("size"), F.array(step(F.col("size"))))
    below = F.when(F.col("most") >= least, F.sequence(step(least), step(F.least("most", "size"))))
    roles = F.array(F.struct(F.lit(True).alias("small"), own.alias("steps")), F.struct(F.lit(False).alias("small"), below.alias("steps")))
    posts = posts.where(F.col("most") >= least).select("*", F.explode(roles).alias("role"))
    posts = posts.select("node", "size", "most", "gram", "role.small", F.explode("role.steps").alias("step"))
    lists = posts.groupBy("gram", "step").agg(F.bool_or("small").alias("s"), F.bool_or(~F.col("small")).alias("l")).where("s AND l")
    key = F.xxhash64("gram", "step").alias("list")
    weight = (F.col("most") - F.col("size")).alias("weight")
    return posts.join(_shuffled(lists), ["gram", "step"]).select(key, "node", weight, "size", "most", "small")


def _open(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that hold several components, with each posting's component.

    Of full sets' lists only postings whose bounds allow some partner in the list.
    """
    tagged = posts.join(labels, "node", "left").select(*posts.columns, F.coalesce("label", "node").alias("label"))
    several = (F.min("label") < F.max("label")).alias("several")
    if "small" not in posts.columns:
        lists = tagged.groupBy("list").agg(several).where("several").select("list")
        return as_table(tagged.join(lists, "list"), "minhash-open")
    ends = [f(F.when(F.col("small") == (role == "s"), F.col(c))).alias(f"{name}_{role}") for role in "sl" for name, f, c in (("least", F.min, "size"), ("far", F.max, "most"))]
    lists = tagged.groupBy("list").agg(several, *ends).where("several AND least_s IS NOT NULL AND least_l IS NOT NULL")
    as_small = F.col("small") & (F.col("least_l") <= F.col("most")) & (F.col("size") <= F.col("far_l"))
    as_large = ~F.col("small") & (F.col("least_s") <= F.col("most")) & (F.col("size") <= F.col("far_s"))
    return as_table(tagged.join(lists, "list").where(as_small | as_large).select(*posts.columns, "label"), "minhash-open")


def _led(lists: DataFrame, leaders: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of leaders and their list's classes in other components, lists without the leaders)."""
    rest = [c for c in lists.columns if c not in ("list", "weight")]
    salt = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(leaders))
    best = lists.groupBy("list", salt.alias("salt")).agg(F.max(F.struct("weight", *rest)).alias("lead"))
    best = as_table(best.select("list", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in rest]), "minhash-leaders")
    fits = F.col("lead_label") != F.col("label")
    if "small" in rest:
        lead_larger = F.col("lead_size") >= F.col("size")
        fits &= F.when(F.col("lead_small"), ~F.col("small") & (F.col("size") >= F.col("lead_size"))).otherwise(F.col("small") & lead_larger)
        fits &= (F.col("size") <= F.col("lead_most")) & (F.col("lead_size") <= F.col("most"))
    pairs = lists.join(best, "list").where(fits).select(F.col("lead_node").alias("a"), F.col("node").alias("b"))
    role = [lists["node"] == best["lead_node"]] + ([lists["small"] == best["lead_small"]] if "small" in rest else [])
    left = lists.join(best, [lists["list"] == best["list"], *role], "left_anti")
    return pairs, left


def _unasked(pairs: DataFrame, asked: list[DataFrame]) -> DataFrame:
    """Pairs (a, b), each once in either order, but for those of `asked`; noted there for later rounds.

    The table is as large as what is compared in a round, which it precedes.
    """
    new = pairs.select("a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).dropDuplicates(["lo", "hi"])
    for before in asked:
        new = new.join(before.select("lo", "hi"), ["lo", "hi"], "left_anti")
    asked.append(as_table(new, "minhash-pairs"))
    return asked[-1].select("a", "b")


def _agreeing(pairs: DataFrame, sigs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree often enough and whose sizes allow the threshold."""
    side = lambda x: sigs.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold
    equal = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.where(sizes).where(equal >= MATCHES).select("a", "b")


def members(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_shingles, and its component's lead_id and lead_hash.

    The lead is the least (doc_id, text_hash) of the component. MATCHES is meant for THRESHOLD: under it,
    links would be lost (6% of those at 0.6), so it is refused.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"threshold must be at least {THRESHOLD}")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    schema = "doc_id long, text_hash long, n_shingles long, set_key binary, sig array<int>"
    slim = as_table(texts.mapInArrow(_signatures(width), schema), "minhash-rows")
    lead = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("lead")
    any_hash = F.min("text_hash").alias("any_hash")
    classes = as_table(
        slim.where("n_shingles > 0").groupBy("set_key").agg(lead, any_hash, F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
        .select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("lead.doc_id").alias("lead_id"), F.coalesce("lead.text_hash", "any_hash").alias("lead_hash"), "sig", "n_shingles"),
        "minhash-classes",
    )
    # of their own: as some of many columns, Spark takes arrays for a fifth of what they are
    sigs = as_table(classes.select("node", "sig", "n_shingles"), "minhash-sigs")
    classes = classes.drop("sig", "n_shingles")

    place_of = (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long") + F.lit(1 << 31)).alias("list")
    posted = sigs.select("node", F.posexplode("sig").alias("at", "value")).select("node", place_of)
    often = posted.groupBy("list").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = posted.join(_shuffled(often), "list")
    # values posted once come first in the order; they are COORDS minus those that are shared
    mine = Window.partitionBy("node")
    place = F.lit(COORDS) - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("often", "list"))
    # what an original has that its edited copies lack: all of its values are shared, and widely
    weight = F.sum("often").over(mine).alias("weight")
    lists = as_table(shared.select("*", place.alias("place"), weight).where(F.col("place") <= PREFIX).select("list", "node", "weight"), "minhash-lists")

    lead = F.max(F.struct("weight", "node"))["node"].alias("a")
    heads = lists.groupBy("list").agg(lead, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = lists.join(_shuffled(heads), "list").where("a <> node").groupBy("node", "a").agg(F.count(F.lit(1)).alias("n"))
    first = stars.groupBy("node").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", F.col("node").alias("b"))

    listed = lists.select("node").distinct().join(classes, "node").select("node", F.col("lead_id").alias("doc_id"), F.col("lead_hash").alias("text_hash"))
    same = (F.col("x.doc_id").eqNullSafe(F.col("y.doc_id"))) & (F.col("x.text_hash") == F.col("y.text_hash"))
    # repeated rows bring a text more than once
    bodies = as_table(listed.alias("x").join(texts.alias("y"), same).select("x.node", "y.text").dropDuplicates(["node"]), "minhash-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        near = _agreeing(pairs, sigs, threshold)
        a = bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return near.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(width, threshold), "a long, b long")

    asked: list[DataFrame] = []
    labels, turn = contract(None, confirmed(_unasked(first, asked))), 0

    def settled(lists: DataFrame, leaders: int) -> DataFrame:
        """What is still open of the lists after one round."""
        nonlocal labels, turn
        pairs, lists = _led(lists, leaders, turn)
        pairs, turn = _unasked(pairs, asked), turn + 1
        if not pairs.isEmpty():
            labels = contract(labels, confirmed(pairs))
        return _open(lists.drop("label"), labels)

    lists = settled(_open(lists, labels), LEADERS)
    if not lists.isEmpty():
        lists, leaders = _open(_full_posts(lists.select("node").distinct(), bodies, width, threshold), labels), FULL_LEADERS
        while not lists.isEmpty():
            lists, leaders = settled(lists, leaders), leaders * GROWTH

    # classes that are linked with others: the least lead of their component
    own = F.struct(F.col("lead_id").isNull().alias("none"), "lead_id", "lead_hash")
    named = classes.join(labels, "node").select("set_key", "label", own.alias("own"))
    least = named.groupBy("label").agg(F.min("own").alias("least"))
    ends = named.join(least, "label").select("set_key", F.col("least.lead_id").alias("far_id"), F.col("least.lead_hash").alias("far_hash"))
    alone = classes.select("set_key", "lead_id", "lead_hash")
    every = as_table(alone.join(ends, "set_key", "left").select(
        "set_key", F.when(F.col("far_hash").isNull(), F.col("lead_id")).otherwise(F.col("far_id")).alias("lead_id"), F.coalesce("far_hash", "lead_hash").alias("lead_hash")
    ), "minhash-leads")
    return slim.select("doc_id", "text_hash", "n_shingles", "set_key").join(_shuffled(every), "set_key", "left").drop("set_key")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    component = F.when(F.col("n_shingles") > 0, F.col("lead_id")).otherwise(F.col("doc_id"))
    out = members(docs, width, threshold).select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one row of each group of near copies: that of the least (doc_id, hash of the text), null ids last.

    Of repeated rows of it, that with the least hash of all columns stays; rows without words all stay.
    """
    known = members(docs, width, threshold).where("n_shingles > 0")
    leads = F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("text_hash") == F.col("lead_hash"))
    keys = known.groupBy("doc_id", "text_hash").agg(F.bool_or(leads).alias("leads"), F.count(F.lit(1)).alias("n"))
    keys = as_table(keys.where("n > 1 OR NOT leads").select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"), "leads"), "minhash-keys")
    row = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    same = F.col("id").eqNullSafe(F.col("key_id")) & (F.col("hash") == F.col("key_hash"))
    once = row.join(keys, same, "left_anti").select("row")
    order = Window.partitionBy("id", "hash").orderBy(F.xxhash64("row"))
    repeated = row.join(keys.where("leads"), same, "left_semi").withColumn("nth", F.row_number().over(order)).where("nth = 1").select("row")
    return once.unionByName(repeated).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 4-word shingles at a similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


OP8_SQL = None
