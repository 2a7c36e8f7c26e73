"""Similarity join of n-gram sets by prefix filters under several global orders.

Two sets of Jaccard similarity t or more share a token among the first p tokens of both, under any order
of all tokens, where p = n - ceil(t n) + 1. The orders here all begin with the tokens of a single set, so
that these never need to move: (1) by how many sets hold the token, then by the token; (2) and (3) by two
other hashes of the token. Candidates come from the postings of order 1, and only pairs that also share
prefix tokens under orders 2 and 3 are verified by the exact overlap.

Equal sets are one class and enter once. Postings of a token may be long, so pairs within one are not
all listed: rounds of stars compare every set of a list with a few members (others each round), and lists whose
sets are already connected are done. When what is left could make no more pairs than there are postings, or
stars link hardly anything more, what is left of the lists is compared block by block: of all pairs
between different components, those that sizes, places in the order and sketches allow are verified.
So no link that connects two components is lost, whatever the lists' length.

Token hashes have 48 bits: two tokens of one pair of sets collide with a chance under one in 10^8 for
sets of a thousand tokens.

Defined results: texts without words have the empty set and link with nothing; null ids are carried
(their component is the smallest id connected, or null); repeated rows are all returned; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .components import in_few_tasks, stars
from .words import mixed, pack48, shingle_set, unpack48, words_of
from .worker import let_go

SHINGLE = 5
PERCENT = 75
BUCKET_TOKENS = 1 << 21  # of all sets, that one task sorts at a time
STAR_ROUNDS = 12
BLOCK_SETS = 1024  # of a list, that meet another such block in a task
HEADS = 4  # members of a list that a round compares all others with
SKETCH_BITS = 2048
USEFUL = 500  # a round of stars that links fewer sets than one for so many postings is the last one
_TOKEN = np.uint64((1 << 48) - 1)


def _set_of(text: str | None, width: int) -> np.ndarray:
    return shingle_set(words_of(text, lower=True), width)


def _class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _sizes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            sets = [_set_of(text, width) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("key"), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_class_of(x) if len(x) else None for x in sets], pa.int64()),
                ],
                names=["doc_id", "key", "n", "class"],
            )

    return run


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return start, np.diff(np.r_[start, len(values)])


def _bucketed(bucket: np.ndarray, owner: np.ndarray, token: np.ndarray, df: np.ndarray | None) -> pa.RecordBatch:
    """One row per bucket: owners with the number of their tokens, and the tokens. The tokens of an
    owner come one after the other."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    bucket, owner, token = bucket[order], owner[order], token[order]
    rows = {"bucket": [], "owners": [], "counts": [], "tokens": [], "dfs": []}
    for a, n in zip(*_runs(bucket), strict=True):
        start, length = _runs(owner[a: a + n])
        rows["bucket"].append(int(bucket[a]))
        rows["owners"].append(owner[a: a + n][start].tobytes())
        rows["counts"].append(length.astype("<u4").tobytes())
        rows["tokens"].append(pack48(token[a: a + n]))
        rows["dfs"].append(b"" if df is None else np.minimum(df[order][a: a + n], 2**32 - 1).astype("<u4").tobytes())
    return pa.RecordBatch.from_pydict(rows, _PACKED)


_PACKED = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("owners", "counts", "tokens", "dfs"))])
_PACKED_DDL = "bucket int, owners binary, counts binary, tokens binary, dfs binary"


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cols = {c: b"".join(x.as_py() for x in table.column(c)) for c in ("owners", "counts", "tokens", "dfs")}
    owner = np.repeat(np.frombuffer(cols["owners"], np.int64), np.frombuffer(cols["counts"], "<u4"))
    return owner, unpack48(cols["tokens"]), np.frombuffer(cols["dfs"], "<u4")


def _tokens(width: int, bits: int):
    """Tokens of the sets by bucket (their first bits); of equal sets in a batch one counts."""
    shift = np.uint64(48 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            token = np.concatenate(sets)
            owner = np.repeat(np.array(owners, np.int64), [len(x) for x in sets])
            return _bucketed((token >> shift).astype(np.int32), owner, token, None)

        let_go()
        sets, owners, size = [], [], 0
        for batch in batches:
            seen: set[int] = set()
            for text in batch.column("text").to_pylist():
                tokens = _set_of(text, width)
                if not len(tokens) or (key := _class_of(tokens)) in seen:
                    continue
                seen.add(key)
                sets.append(tokens & _TOKEN)
                owners.append(key)
                size += len(tokens)
                if size >= BUCKET_TOKENS:
                    yield out()
                    sets, owners, size = [], [], 0
        if sets:
            yield out()

    return run


def _shared(parts: int):
    """Of one bucket, the tokens that several sets hold, by part of their owners."""

    def run(table: pa.Table) -> pa.Table:
        owner, token, _ = _unpacked(table)
        order = np.lexsort((owner, token))
        owner, token = owner[order], token[order]
        once = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]
        owner, token = owner[once], token[once]
        _, length = _runs(token)
        df = np.repeat(length, length)
        many = df > 1
        owner, token, df = owner[many], token[many], df[many]
        order = np.argsort(owner, kind="stable")
        owner, token, df = owner[order], token[order], df[order]
        part = (mixed(owner.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        return pa.Table.from_batches([_bucketed(part, owner, token, df)])

    return run


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _by_order(tokens: np.ndarray, order: int) -> np.ndarray:
    """Shared tokens by one of the orders; they come in order 1."""
    if order == 1:
        return tokens
    return tokens[np.argsort(mixed(tokens + np.uint64(order)), kind="stable")]


def _sketch(tokens: np.ndarray) -> bytes:
    """A bit for each token; two sets differ in at least as many tokens as their sketches in bits."""
    bits = np.zeros(SKETCH_BITS, np.uint8)
    bits[mixed(tokens + np.uint64(9)) % np.uint64(SKETCH_BITS)] = 1
    return np.packbits(bits).tobytes()


def _survivors(percent: int):
    """Sets with a shared token in their prefix: (class, n, own tokens, shared tokens in order 1, how many
    sets hold those of the prefix)."""
    schema = pa.schema([
        ("class", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("sketch", pa.binary()), ("tokens", pa.binary()),
        ("dfs", pa.binary()),
    ])

    def run(classes: pa.Table, entries: pa.Table) -> pa.Table:
        rows = {c: [] for c in schema.names}
        if classes.num_rows and entries.num_rows:
            size = dict(zip(classes.column("class").to_pylist(), classes.column("n").to_pylist(), strict=True))
            owner, token, df = _unpacked(entries)
            order = np.lexsort((token, df, owner))
            owner, token, df = owner[order], token[order], df[order]
            for a, shared in zip(*_runs(owner), strict=True):
                n = size[int(owner[a])]
                if n - shared < _prefix(n, percent):
                    rows["class"].append(int(owner[a]))
                    rows["n"].append(n)
                    rows["alone"].append(int(n - shared))
                    rows["sketch"].append(_sketch(token[a: a + shared]))
                    rows["tokens"].append(pack48(token[a: a + shared]))
                    prefix = min(int(shared), _prefix(n, percent) - int(n - shared))
                    rows["dfs"].append(df[a: a + prefix].astype("<u4").tobytes())
        return pa.Table.from_pydict(rows, schema)

    return run


def _postings(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                unpack48(tokens)[: _prefix(n, percent) - alone]
                for n, alone, tokens in zip(*(batch.column(c).to_pylist() for c in ("n", "alone", "tokens")), strict=True)
            ]
            lengths = [len(x) for x in found]
            dfs = np.frombuffer(b"".join(batch.column("dfs").to_pylist()), "<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).astype(np.int64)),
                    pa.array(np.repeat(batch.column("class").to_numpy(), lengths)),
                    pa.array(np.repeat(batch.column("n").to_numpy(), lengths)),
                    pa.array(np.concatenate([*(k + np.arange(m) for k, m in zip(batch.column("alone").to_pylist(), lengths, strict=True)), np.empty(0, np.int64)]).astype(np.int64)),
                    pa.array(dfs.astype(np.int64)),
                ],
                names=["token", "class", "n", "place", "df"],
            )

    return run


def _verify(percent: int):
    def linked(n: int, alone_n: int, x: np.ndarray, m: int, alone_m: int, y: np.ndarray) -> bool:
        for order in (2, 3):
            p, q = _prefix(n, percent) - alone_n, _prefix(m, percent) - alone_m
            if not len(np.intersect1d(_by_order(x, order)[:p], _by_order(y, order)[:q], assume_unique=True)):
                return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (n + m - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            keep = [
                linked(n, k, unpack48(x), m, j, unpack48(y))
                for n, k, x, m, j, y in zip(*(cols[c] for c in ("n", "alone", "tokens", "n2", "alone2", "tokens2")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return run


def _differ_little(x: dict[str, np.ndarray], y: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Which pairs (a row for each of ``x``, a column for each of ``y``) can be links, by their places
    under the shared token, sizes and sketches; sets already connected are none."""
    total = x["n"][:, None] + y["n"]
    least = -(-percent * total // (100 + percent))  # of common tokens
    left = np.minimum((x["n"] - x["place"])[:, None], y["n"] - y["place"])
    rows, columns = np.nonzero((x["label"][:, None] != y["label"]) & (left >= least))
    apart = np.bitwise_count(x["sketch"][rows] ^ y["sketch"][columns]).sum(axis=1, dtype=np.int64)
    near = apart + x["alone"][rows] + y["alone"][columns] <= (total - 2 * least)[rows, columns]
    out = np.zeros(total.shape, bool)
    out[rows[near], columns[near]] = True
    return out


def _list_pairs(percent: int):
    """Pairs that can be links within each cell (token, one, two): all of block ``one`` with all of
    block ``two`` of the token's list. Rows come sorted by cell."""

    def cell(one: int, two: int, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        first, second = rows["block"] == one, rows["block"] == two
        x, y = ({k: v[m] for k, v in rows.items()} for m in (first, second))
        a, b = [], []
        for at in range(0, len(x["n"]), 64):
            part = {k: v[at: at + 64] for k, v in x.items()}
            i, j = np.nonzero(_differ_little(part, y, percent))
            a.append(part["class"][i])
            b.append(y["class"][j])
        a, b = (np.concatenate([*z, np.empty(0, np.int64)]) for z in (a, b))
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "one", "two", "block", "class", "n", "place", "alone", "label")
        held: dict[str, np.ndarray] | None = None
        seen: set[tuple[int, int]] = set()

        def done(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            cuts = np.flatnonzero((np.diff(rows["token"]) != 0) | (np.diff(rows["one"]) != 0) | (np.diff(rows["two"]) != 0)) + 1
            new = []
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(rows["token"])].tolist(), strict=True):
                part = {k: v[a:b] for k, v in rows.items()}
                for pair in zip(*(z.tolist() for z in cell(int(part["one"][0]), int(part["two"][0]), part)), strict=True):
                    if pair[0] != pair[1] and pair not in seen:
                        seen.add(pair)
                        new.append(pair)
            if len(seen) > 1_000_000:  # only saves rows; what repeats is dropped later
                seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in new], pa.int64()) for k in (0, 1)], names=["a", "b"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy() for c in names}
            rows["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH_BITS // 8)
            if held is not None:
                rows = {k: np.concatenate((held[k], rows[k])) for k in rows}
            last = np.flatnonzero(
                (rows["token"] != rows["token"][-1]) | (rows["one"] != rows["one"][-1]) | (rows["two"] != rows["two"][-1])
            )
            at = int(last[-1]) + 1 if len(last) else 0
            if at:
                yield done({k: v[:at] for k, v in rows.items()})
            held = {k: v[at:] for k, v in rows.items()}
        if held is not None:
            yield done(held)

    return run


def _open_pairs(rows: DataFrame, total: int, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of the open lists (``total`` rows at most) that can be links, in cells of bounded blocks."""
    blocks = rows.groupBy("token").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    sketched = in_few_tasks(rows.join(sets.select("class", "alone", "sketch"), "class"), total)
    placed = in_few_tasks(sketched.join(blocks, "token"), total)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("class", F.lit(77)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = placed.withColumn("other", other).select(
        "token", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
        "block", "class", "n", "place", "alone", "label", "sketch",
    )
    return cells.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two").mapInArrow(
        _list_pairs(percent), "a long, b long"
    ).distinct()


def _may_link(percent: int):
    """Pairs whose sketches do not show that they differ too much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH_BITS // 8) for c in ("sketch", "sketch2"))
            n, alone, m, alone2 = (batch.column(c).to_numpy() for c in ("n", "alone", "n2", "alone2"))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) + alone + alone2
            least = -(-percent * (n + m) // (100 + percent))  # of common tokens
            yield batch.select(["a", "b"]).filter(pa.array(apart <= n + m - 2 * least))

    return run


def _verified(pairs: DataFrame, most: int, sets: DataFrame, percent: int, sketched: bool) -> DataFrame:
    """The linked pairs (a, b) of ``pairs``, which has ``most`` rows at most; ``sketched`` tells that sketches
    have been compared."""

    def sides(frame: DataFrame, column: str) -> DataFrame:
        left = sets.select(F.col("class").alias("a"), "n", "alone", column)
        right = sets.select(
            F.col("class").alias("b"), F.col("n").alias("n2"), F.col("alone").alias("alone2"), F.col(column).alias(f"{column}2")
        )
        return in_few_tasks(frame.join(left, "a"), most).join(right, "b")

    if not sketched:
        pairs = in_few_tasks(sides(pairs, "sketch"), most).mapInArrow(_may_link(percent), "a long, b long")
    near = written(pairs, "near-pairs")
    checked = sides(near, "tokens").mapInArrow(_verify(percent), "a long, b long, linked boolean")
    return written(checked.where("linked").select("a", "b"), "links")


def _one_list_of_each(postings: DataFrame) -> DataFrame:
    """Of tokens that the same sets hold in their prefixes, the first in order 1, which is by ``df``: sets
    without the token in their prefix count there too, so tokens of a kind may differ in it. The first
    token that two sets share is the first of its kind, so no pair loses it or its place."""
    lists = postings.groupBy("token").agg(
        F.first("df").alias("df"), F.count("*").alias("held"), F.bit_xor(F.xxhash64("class")).alias("x"), F.sum(F.xxhash64(F.lit(5), "class") % (1 << 40)).alias("y")
    )
    firsts = lists.where("held > 1").groupBy("held", "x", "y").agg(F.min(F.struct("df", "token")).alias("first"))
    return written(postings.join(firsts.select("first.token"), "token").drop("df"), "posting-lists")


def _possible(percent: int) -> F.Column:
    """Whether two sets that share a token first at these places can have enough in common."""
    least = F.ceil(percent * (F.col("n") + F.col("n2")) / (100 + percent) - 1e-9)
    return (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (
        F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) >= least
    )


def _links(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the sets that verified links connect to a smaller one, the smallest of all; no link
    between components is lost. Tables of a round are small where lists are, so steps take the tasks that
    their rows are worth: what each task tells the driver would outweigh its rows."""
    spark = sets.sparkSession
    postings = _one_list_of_each(postings)
    total = postings.count()
    labels, linked = spark.createDataFrame([], "node long, label long"), 0
    useful = True
    for turn in range(STAR_ROUNDS + 1):
        rows = in_few_tasks(postings.join(labels, F.col("class") == F.col("node"), "left").select(
            "token", "class", "n", "place", F.coalesce("label", "class").alias("label")
        ), total)
        lists = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        rows = written(in_few_tasks(rows.join(lists.select("token"), "token"), total), "open-postings")
        by_label = in_few_tasks(rows.groupBy("token", "label").count(), total).groupBy("token").agg(
            (F.sum("count") * F.sum("count") - F.sum(F.col("count") * F.col("count"))).alias("crossing")
        )
        crossing = (in_few_tasks(by_label, total).agg(F.sum("crossing")).first()[0] or 0) // 2
        if not crossing:
            break
        last = crossing <= total or not useful or turn == STAR_ROUNDS
        most = crossing if last else HEADS * total  # pairs of this round
        if last:
            pairs = _open_pairs(rows, total, sets, percent)
        else:
            chance = F.xxhash64("class", F.lit(turn))
            first = rows.groupBy("token", F.pmod(chance, F.lit(HEADS)).alias("slot")).agg(
                F.min(F.struct(chance, "class", "n", "place", "label")).alias("head")
            ).select(
                "token", F.col("head.class").alias("c2"), F.col("head.n").alias("n2"),
                F.col("head.place").alias("place2"), F.col("head.label").alias("l2"),
            )
            pairs = in_few_tasks(rows.join(in_few_tasks(first, total), "token"), most)
            pairs = pairs.where((F.col("label") != F.col("l2")) & _possible(percent)).select(
                F.least("class", "c2").alias("a"), F.greatest("class", "c2").alias("b")
            ).distinct()
        found = _verified(in_few_tasks(pairs, most), most, sets, percent, sketched=last)
        new = found.count()
        # what is connected already enters as one pair a set, so that rounds do not add up in the plan
        pairs, linked = stars(found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))), new + linked)
        labels = pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
        if last:
            break
        useful = new * USEFUL > total
    return labels


def similarity_classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per input row: (doc_id, key, n_shingles, component_id, stays). ``key`` is a hash of id and
    text; of each component the row of the smallest id (then key) stays, and all rows without words."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), row_key(docs, text, doc_id).alias("key")
    )
    sized = written(source.mapInArrow(_sizes(width), "doc_id long, key long, n long, class long"), "set-sizes")
    total, texts = sized.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits = max(4, (total // BUCKET_TOKENS).bit_length())
    parts = 1 << bits
    shared = (
        source.select("text").mapInArrow(_tokens(width, bits), _PACKED_DDL)
        .groupBy("bucket").applyInArrow(_shared(parts), _PACKED_DDL)
    )
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "key"))
    classes = sized.where("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.min("doc_id").alias("first_id"), first.alias("first"))
    owned = classes.select("class", "n").mapInArrow(_with_part(parts), "class long, n long, bucket int")
    sets = written(
        owned.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(
            _survivors(percent), "class long, n long, alone long, sketch binary, tokens binary, dfs binary"
        ),
        "sets",
    )
    postings = written(sets.mapInArrow(_postings(percent), "token long, class long, n long, place long, df long"), "postings")
    labels = _links(postings, sets, percent)
    group = in_few_tasks(classes.join(labels, F.col("class") == F.col("node"), "left"), texts).withColumn("label", F.coalesce("label", "class"))
    leaders = group.groupBy("label").agg(F.min("first_id").alias("component_id"), F.min("first").alias("first"))
    named = in_few_tasks(group.select("class", "label").join(leaders, "label"), texts).select("class", "component_id", "first")
    worded = F.col("n") > 0
    return sized.join(named, "class", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"),
        F.when(worded, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (~worded | (F.col("key") == F.col("first.key")) & F.coalesce("doc_id", F.lit((1 << 63) - 1)).eqNullSafe(F.col("first.id"))).alias("stays"),
    )


def row_key(docs: DataFrame, text: str, doc_id: str) -> F.Column:
    return F.xxhash64(docs[f"`{doc_id}`"].cast("long"), docs[f"`{text}`"])


def jaccard_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id)."""
    return similarity_classes(docs, text, doc_id, width, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows that stay, with all their columns."""
    gone = similarity_classes(docs, text, doc_id, width, percent).where("not stays").select(F.col("key").alias("gone key")).distinct()
    return docs.join(gone, row_key(docs, text, doc_id) == F.col("gone key"), "left_anti")


def _with_part(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = mixed(batch.column("class").to_numpy().view(np.uint64)) % np.uint64(parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), batch.column("n"), pa.array(part.astype(np.int32))], names=["class", "n", "bucket"]
            )

    return run
