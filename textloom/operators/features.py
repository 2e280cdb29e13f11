"""Feature windows, vector arithmetic, length buckets and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked

OFFSETS = (3, 2, 1, 0, -1, -2, -3)


def window_of(vector: str, group: list[str], order: str, dim: int, offsets: tuple[int, ...] = OFFSETS) -> Column:
    """The vectors at the offsets after one another, zeros where there is none."""
    w = Window.partitionBy(*group).orderBy(order)
    pad = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return F.concat(*[F.coalesce(F.lead(vector, d).over(w) if d >= 0 else F.lag(vector, -d).over(w), pad) for d in offsets])


def pad_to(vectors: Column, n: int, pad: Column) -> Column:
    """Exactly n items: cut, or filled with ``pad``."""
    return F.slice(F.concat(vectors, F.array_repeat(pad, n)), 1, n)


def argmax(scores: Column, n: int | Column) -> Column:
    """Position from 0 of the largest of the first n scores."""
    some = F.slice(scores, F.lit(1), F.lit(n) if isinstance(n, int) else n)
    return F.array_position(some, F.array_max(some)) - 1


def argmax_label(df: DataFrame, scores: str, labels: DataFrame) -> DataFrame:
    """Adds ``best``, the label (item, cid) of the largest score; scores beyond the number of labels don't count."""
    n = labels.agg(F.count("*").cast("int").alias("__n"))
    some = df.crossJoin(F.broadcast(n)).withColumn("__cid", argmax(F.col(scores), F.col("__n")))  # one row
    return some.join(F.broadcast(labels.select(F.col("cid").cast("long").alias("__cid"), F.col("item").alias("best"))), "__cid", "left").drop("__cid", "__n")  # a row for each score at most


def sentence_matrix(t: DataFrame, vector: str, sid: str = "sid", tid: str = "tid") -> DataFrame:
    """``sid, n, matrix``: the vectors of a sentence's tokens as rows, in order."""
    g = t.groupBy(sid).agg(F.sort_array(F.collect_list(F.struct(tid, F.col(vector).alias("v")))).alias("t"))
    return g.select(sid, F.size("t").alias("n"), F.col("t.v").alias("matrix"))


def bucket(length: Column, splits: list[int]) -> Column:
    """The smallest split that is not less than the length."""
    out = F.lit(None).cast("int")
    for s in sorted(splits, reverse=True):
        out = F.when(length <= s, F.lit(s)).otherwise(out)
    return out


def batches(df: DataFrame, bucket_col: str, order: str, budget: int) -> DataFrame:
    """Batches of about ``budget`` tokens in each bucket, as even parts in order; a bucket of any size is ranked by ranges."""
    n, i = F.col("__n"), F.col("__i")
    parts = F.least(F.greatest(F.floor(n * F.col(bucket_col) / budget), F.lit(1)), n)
    big, size = n % parts, F.floor(n / parts)
    at = F.when(i < big * (size + 1), F.floor(i / (size + 1))).otherwise(big + F.floor((i - big * (size + 1)) / size))
    return ranked(df, [order], [bucket_col], "__i", "__n").withColumn("batch", at).drop("__i", "__n")


PRIME = 2_147_483_647
WALKS = 16


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mixed(seed: Column, turn: int, v: Column) -> Column:
    """A number below PRIME from a seed and a value, in whole numbers that any SQL computes alike."""
    first = ((v % PRIME) * 48_271 + (seed % 65_536) * 16_807 + (turn + 1) * 69_621) % PRIME
    return _let(first, lambda m: ((m * m) % PRIME * 31 + m * 7 + v % PRIME) % PRIME)


def permuted(rank: Column, n: Column, seed: Column | int) -> Column:
    """A bijection of 0..n-1, keyed by ``seed``: places for ranks without a sort.

    The rank is a cell of a grid of a rows and b columns, the least with a x b >= n whose sides are near the root of n. Four turns add to one
    coordinate a number made from the other, which is a bijection of the grid; a cell outside of 0..n-1 is moved on until it is inside. At
    most a - 1 cells are outside, so ``WALKS`` moves suffice for n up to 256, and beyond that all but never fail; failing is an error.
    """
    seed = F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long")
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def turns(u: Column, v: Column, turn: int) -> Column:
        if turn == 4:
            return u * b + v
        return _let((u + _mixed(seed, turn, v)) % a, lambda u: _let((v + _mixed(seed, turn + 1, u)) % b, lambda v: turns(u, v, turn + 2)))

    def move(x: Column) -> Column:
        return _let(F.floor(x / b), lambda u: _let(x % b, lambda v: turns(u, v, 0)))

    walk = F.reduce(F.sequence(F.lit(1), F.lit(WALKS)), -rank.cast("long") - 1, lambda x, _: F.when((x >= 0) & (x < n), x).otherwise(move(F.when(x < 0, -x - 1).otherwise(x))))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("no place found: raise WALKS")).cast("long"))


def shuffled(df: DataFrame, order: list[str], seed: int, within: list[str] | None = None, name: str = "place") -> DataFrame:
    """Adds ``name``, a place in a random order of the rows (of each value of ``within``). It depends on the seed and on the rank by the key ``order``
    only, so it is the same on any partitioning."""
    rows = ranked(df, order, within, "__i", "__n")
    return rows.withColumn(name, permuted(F.col("__i"), F.col("__n"), seed)).drop("__i", "__n")


def sampled_batches(df: DataFrame, bucket_col: str, order: str, budget: int, seed: int, epoch: int) -> DataFrame:
    """Adds ``batch``, its number in the epoch, and ``slot``, the place in it: each row once an epoch, in batches of one bucket.

    A bucket holds ``budget`` tokens a batch, so a batch of long sentences has fewer; its quota is as many batches as its rows fill. Rows are dealt to
    the batches of their bucket, and batches to their turn, by the permutations of seed and epoch.
    """
    key = seed * 1_009 + epoch
    size = F.greatest(F.floor(F.lit(budget) / F.col(bucket_col)), F.lit(1))
    rows = ranked(df, [order], [bucket_col], "__i", "__n").withColumn("__place", permuted(F.col("__i"), F.col("__n"), F.lit(key) + F.col(bucket_col)))
    quota = df.groupBy(bucket_col).agg(F.count("*").alias("__rows")).withColumn("__quota", F.ceil(F.col("__rows") / size))
    quota = ranked(quota, [bucket_col], name="__b").orderBy("__b").select(bucket_col, "__quota")  # a row for each bucket
    w = Window.partitionBy(F.lit(0)).orderBy(bucket_col)
    quota = quota.withColumn("__from", F.sum("__quota").over(w) - F.col("__quota")).withColumn("__all", F.sum("__quota").over(Window.partitionBy(F.lit(0))))
    rows = rows.join(F.broadcast(quota), bucket_col).withColumn("batch", permuted((F.col("__from") + F.floor(F.col("__place") / size)).cast("long"), F.col("__all").cast("long"), key))
    return rows.withColumn("slot", (F.col("__place") % size).cast("long")).drop("__i", "__n", "__place", "__quota", "__from", "__all")


def concat_named(vectors: dict[str, Column]) -> Column:
    """Vectors after one another in the order of their names."""
    return F.concat(*[vectors[k] for k in sorted(vectors)])


def word_vectors(t: DataFrame, word: str, table: DataFrame, dim: int, loose: bool = True) -> DataFrame:
    """Adds ``vector`` from ``table`` (word, vector): the word as it is, and if ``loose`` in lower case, then with its digits as #, then
    as 0; zeros where there is none. Distinct words are looked up, not tokens."""
    from ..functions.chars import collapse_key

    keys = collapse_key(F.col("__w")) if loose else [F.col("__w")]
    own = t.select(F.col(word).alias("__w")).where("__w is not null").distinct()
    tried = own.select("__w", F.posexplode(F.array(*keys)).alias("turn", "key"))
    hit = tried.join(table.select(F.col("word").alias("key"), F.col("vector").alias("__v")), "key").groupBy("__w").agg(F.min_by("__v", "turn").alias("__v"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return t.join(hit.withColumnRenamed("__w", word), word, "left").withColumn("vector", F.coalesce(F.col("__v").cast("array<double>"), zeros)).drop("__v")


def padded_batch(t: DataFrame, group: str, order: str, ids: str, labels: str, batch: str | None = None) -> DataFrame:
    """``group, ids, labels`` as arrays of the longest length in the group's ``batch`` (of the rows, if none is named): ids padded with 0,
    labels with -1. The batch is the first column, if named."""
    b = batch or "__batch"
    rows = t if batch else t.withColumn(b, F.lit(0))
    g = rows.groupBy(b, group).agg(F.sort_array(F.collect_list(F.struct(order, ids, labels))).alias("t"))
    longest = rows.groupBy(b, group).agg(F.count("*").alias("n")).groupBy(b).agg(F.max("n").cast("int").alias("n"))
    fill = lambda c, pad: F.slice(F.concat(F.col(c).cast("array<long>"), F.array_repeat(F.lit(pad).cast("long"), F.col("n"))), F.lit(1), F.col("n"))
    return g.join(longest, b).select(*([batch] if batch else []), group, fill(f"t.{ids}", 0).alias("ids"), fill(f"t.{labels}", -1).alias("labels"))


def length_splits(histogram: dict[int, int], k: int, passes: int = 1_000) -> list[int]:
    """Largest lengths of ``k`` buckets: even parts of the sorted lengths, made distinct, then moved while padding falls.

    The histogram has a row for each length, whatever the number of texts; fewer lengths than buckets are an error.
    """
    lens = sorted(histogram)
    if len(lens) < k:
        raise ValueError(f"{len(lens)} lengths for {k} buckets")
    total, upto, at = sum(histogram.values()), 0, []
    bounds = [(i + 1) * (total // k) + min(i + 1, total % k) for i in range(k)]
    for i, n in enumerate(lens):
        upto += histogram[n]
        at += [i] * sum(1 for b in bounds[len(at) :] if b <= upto)
    for j in range(k - 2, -1, -1):  # from the right: below the next, if there is room
        at[j] = min(at[j], at[j + 1] - 1)
    for j in range(k):
        at[j] = max(at[j], j, at[j - 1] + 1 if j else 0)
    rows = [0]
    for n in lens:
        rows.append(rows[-1] + histogram[n])

    def padding(j: int, i: int) -> int:
        """Cells of the two buckets that the split j parts, if it stood at i."""
        first = at[j - 1] + 1 if j else 0
        return (rows[i + 1] - rows[first]) * lens[i] + (rows[at[j + 1] + 1] - rows[i + 1]) * lens[at[j + 1]]

    for _ in range(passes):
        before = list(at)
        for j in range(k - 1):
            here, low = padding(j, at[j]), at[j - 1] + 1 if j else 0
            if at[j] > low and padding(j, at[j] - 1) < here:
                at[j] -= 1
            elif at[j] + 1 < at[j + 1] and padding(j, at[j] + 1) <= here:
                at[j] += 1
        if at == before:
            break
    return [lens[i] for i in at]


def char_stream(docs: DataFrame, vocab: DataFrame, backward: bool = False) -> DataFrame:
    """``doc_id, pos, id`` of the characters of each text in ``vocab`` (item, cid), 0 for others; reversed if ``backward``."""
    text = F.reverse("text") if backward else F.col("text")
    c = docs.select("doc_id", F.posexplode(F.array_remove(F.split(text, ""), "")).alias("pos", "item"))
    return c.join(F.broadcast(vocab.select("item", "cid")), "item", "left").select("doc_id", "pos", F.coalesce("cid", F.lit(0)).cast("long").alias("id"))


def stream_batches(stream: DataFrame, columns: int) -> DataFrame:
    """``doc_id, row, col, id, target`` of a stream in so many columns of equal length; what is left over goes, and the last row
    has no target."""
    w = Window.partitionBy("doc_id")
    n = F.floor(F.count("*").over(w) / columns)
    cells = stream.select("doc_id", "pos", "id", n.alias("n")).where("pos < n * " + str(columns))
    cells = cells.select("doc_id", (F.col("pos") % F.col("n")).alias("row"), F.floor(F.col("pos") / F.col("n")).alias("col"), "id")
    return cells.withColumn("target", F.lead("id").over(Window.partitionBy("doc_id", "col").orderBy("row")))


def char_offsets(t: DataFrame) -> DataFrame:
    """``sid, tid, forward, backward``: where a character model's state is read, at a token's end in the text of tokens with blanks
    between, and at its beginning in the reversed text."""
    w = Window.partitionBy("sid").orderBy("tid")
    end = F.sum(F.length("tok") + 1).over(w) - 1
    whole = F.sum(F.length("tok") + 1).over(Window.partitionBy("sid")) - 1
    return t.select("sid", "tid", end.alias("forward"), (whole - end + F.length("tok")).alias("backward"))


def original_order(df: DataFrame, bucket_col: str, index: str, key: str = "doc_id") -> DataFrame:
    """``key, bucket, index, place``: where a row of (bucket, index in it) stood before bucketing, by its key."""
    return ranked(df, [key], name="place").select(key, bucket_col, index, "place")
