"""Similarity comparison of many vectors.

Vectors are compared in *blocks*: every group (a session, say) is laid out as blocks of bounded size, each task
multiplies two blocks with numpy, and a task emits only what its kernel reduces the products to - the pairs over a
threshold, the best partner of each row, a spanning forest - never all pairs of a group.

A group larger than one block is compared as a triangle of block pairs, each a task of its own: exact whatever the
vectors are, and a group of any size is spread over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window

from pulseloom import settings
from pulseloom.session import cut, discard, stored

Kernel = Callable[..., pa.Table]
BUCKET_ROWS = 64  # rows that a bucket of candidates holds at least
COPY_ROWS = 1024  # comparisons that cost as much as one more copy of a vector
COPY_CELLS = 1 << 20  # components of copies that a task makes at once
STRIP_CELLS = 1 << 20  # products that a task holds at once
BUNDLES = 8       # of blocks of a large group, at least, where there are few groups; a vector is copied once for each bundle
BUNDLE_CELLS = 1 << 21  # components of the vectors of a bundle
ROUND_COPIES = 6  # of a vector that are laid out at once
MEETINGS = 1 << 20  # codes that are compared at once
PROBES = 2        # least certain signs of a code that are tried the other way


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as a matrix, without a Python object per row."""
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(flat), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    length[length == 0] = 1.0
    return m / length[:, None]


def over(sims: np.ndarray, threshold: float, inclusive: bool) -> np.ndarray:
    return sims >= threshold if inclusive else sims > threshold


def _nonzero(df: DataFrame, vec: str) -> DataFrame:
    """Zero vectors are similar to nothing, whatever the threshold."""
    return df.filter(F.exists(vec, lambda x: x != 0))


def apart(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, so that a frame can be co-grouped with its own descendant."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("_rows"))


def any_large(sizes: DataFrame, block_rows: int) -> bool:
    return sizes.filter(F.col("_rows") > block_rows).limit(1).count() > 0


def _block_tasks(df: DataFrame, keys: list[str], block_rows: int, bundles: int) -> DataFrame:
    """Repeat each row once for every pair of bundles of blocks it takes part in; task (a, b) compares bundles a <= b of a group.

    ``_rows`` is null for a group of one block. A bundle grows with its group up to ``BUNDLE_CELLS``, so copies of a vector stay few.
    """
    blocks = F.coalesce(F.ceil(F.col("_rows") / F.lit(block_rows)), F.lit(1))
    bundles = F.least(blocks, F.greatest(F.lit(bundles), F.ceil(F.coalesce("_rows", F.lit(0)) * F.col("_dim") / F.lit(BUNDLE_CELLS))))
    placed = df.withColumn("_block", F.pmod(F.xxhash64("_id", F.lit(1)), blocks).cast("int"))
    placed = placed.withColumn("_bundle", F.floor(F.col("_block") * bundles / blocks).cast("int"))
    bundle = F.col("_bundle")
    tasks = F.transform(F.sequence(F.lit(0), (bundles - 1).cast("int")), lambda j: F.struct(F.least(bundle, j).alias("a"), F.greatest(bundle, j).alias("b")))
    return placed.withColumn("_task", F.explode(tasks)).withColumn("_a", F.col("_task.a")).withColumn("_b", F.col("_task.b")).drop("_task", "_rows")


def compare_blocks(df: DataFrame, keys: list[str], kernel: Kernel, schema: str | T.StructType, threshold: float,
                   block_rows: int = settings.BLOCK_ROWS, bundles: int = BUNDLES) -> DataFrame:
    """Run ``kernel`` on every pair of blocks of every group.

    ``df`` holds ``keys``, ``_id``, ``_vec`` and whatever columns the kernel reads; vectors of different length are
    kept apart. ``kernel(left, right, sims, same)`` gets two Arrow tables, their cosine matrix, and whether both sides
    are the same block (then only pairs above the diagonal count).
    """
    df = _nonzero(df, "_vec").withColumn("_dim", F.size("_vec"))
    keys = keys + ["_dim"]
    sizes = group_sizes(df, keys)
    if any_large(sizes, block_rows):
        # rows stay where they are: only large groups are told, of which there are few
        known = df.filter(F.expr(" and ".join(f"`{k}` is not null" for k in keys)))
        tasks = _block_tasks(known.join(F.broadcast(sizes.filter(F.col("_rows") > block_rows)), keys, "left"), keys, block_rows, bundles)
    else:
        tasks = df.withColumn("_block", F.lit(0)).withColumn("_bundle", F.lit(0)).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(0))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id")
        a, b = table["_a"][0].as_py(), table["_b"][0].as_py()
        block, bundle = table["_block"].to_numpy(), table["_bundle"].to_numpy()
        vectors = unit_rows(matrix(table["_vec"]))
        rows = {k: np.nonzero(block == k)[0] for k in np.unique(block).tolist()}
        parts = {k: table.take(pa.array(at)) for k, at in rows.items()}
        side = lambda which: np.unique(block[bundle == which]).tolist()
        found = [kernel(parts[x], parts[y], vectors[rows[x]] @ vectors[rows[y]].T, x == y) for x in side(a) for y in side(b) if a != b or x <= y]
        if not found:  # no row fell to one of the sides
            one = next(iter(parts.values()))
            found = [kernel(one, one.slice(0, 0), np.zeros((one.num_rows, 0)), False)]
        return pa.concat_tables(found)

    return tasks.groupBy(*keys, "_a", "_b").applyInArrow(run, schema)


def _prepared(df: DataFrame, keys: list[str], id_col: str, vec_col: str, **extra: Column | str) -> DataFrame:
    more = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in extra.items()]
    floats = df.schema[vec_col].dataType == T.ArrayType(T.FloatType(), True)  # travel as they are; a task makes doubles of them
    vec = F.col(vec_col) if floats else F.col(vec_col).cast("array<double>")
    return df.select(*keys, F.col(id_col).alias("_id"), vec.alias("_vec"), *more)


def similar_pairs(df: DataFrame, threshold: float, *, keys: list[str], id_col: str, vec_col: str,
                  inclusive: bool = False, block_rows: int = settings.BLOCK_ROWS) -> DataFrame:
    """All pairs of a group whose cosine passes the threshold: ``keys, id_a, id_b, sim`` with ``id_a < id_b``."""
    return _pairs(_prepared(df, keys, id_col, vec_col), threshold, keys, inclusive, block_rows)


def _pairs(prepared: DataFrame, threshold: float, keys: list[str], inclusive: bool, block_rows: int,
           wanted: Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], np.ndarray] | None = None, bundles: int = BUNDLES) -> DataFrame:
    """``similar_pairs`` of prepared rows; of two tables and the rows of both in each pair, ``wanted`` tells which pairs to hand on."""
    id_field = prepared.schema["_id"]
    schema = T.StructType([prepared.schema[k] for k in keys] + [
        T.StructField("id_a", id_field.dataType), T.StructField("id_b", id_field.dataType),
        T.StructField("sim", T.DoubleType())])

    def kernel(left: pa.Table, right: pa.Table, sims: np.ndarray, same: bool) -> pa.Table:
        hit = over(sims, threshold, inclusive)
        if same:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        if wanted and len(i):
            new = wanted(left, right, i, j)
            i, j = i[new], j[new]
        columns = {k: left[k].take(pa.array(i)) for k in keys}
        return pa.table({**columns, "id_a": left["_id"].take(pa.array(i)), "id_b": right["_id"].take(pa.array(j)),
                         "sim": pa.array(sims[i, j])})

    found = compare_blocks(prepared, keys, kernel, schema, threshold, block_rows, bundles)
    a, b = F.col("id_a"), F.col("id_b")
    return found.select(*keys, F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"), "sim")


def vector_classes(df: DataFrame, *, keys: list[str], id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """``keys, id, vec`` of the distinct vectors of each group, named by their smallest id, and ``keys, id, representative`` of all rows."""
    rows = df.select(*keys, F.col(id_col), F.col(vec_col))
    classes = cut(rows.groupBy(*keys, vec_col).agg(F.min(id_col).alias(id_col)).select(*keys, id_col, vec_col))
    members = rows.join(classes.withColumnRenamed(id_col, "representative"), keys + [vec_col]).select(*keys, id_col, "representative")
    return classes, members


def similar_classes(df: DataFrame, threshold: float, *, keys: list[str], id_col: str, vec_col: str, inclusive: bool = False,
                    block_rows: int = settings.BLOCK_ROWS, recall: float | None = None) -> tuple[DataFrame, DataFrame]:
    """All similar pairs in linear space: ``keys, id_a, id_b, sim`` between representatives of distinct vectors, and the members.

    Two rows are similar if their representatives are a pair, or if they share one (their similarity is one, unless it is the
    zero vector). So n equal vectors give n rows, not n²/2. With ``recall`` the pairs come from ``candidate_pairs``.
    """
    classes, members = vector_classes(df, keys=keys, id_col=id_col, vec_col=vec_col)
    how = dict(keys=keys, id_col=id_col, vec_col=vec_col, inclusive=inclusive, block_rows=block_rows)
    pairs = similar_pairs(classes, threshold, **how) if recall is None else candidate_pairs(classes, threshold, recall=recall, **how)
    return pairs, members


def _tables_for(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a code and number of tables, by which a pair just at the threshold is met with the given probability.

    Two vectors at an angle a have equal signs in a random projection with probability 1 - a / pi. More bits make smaller
    buckets but need more tables, and a vector travels once for each code of each table (and block of a large bucket).
    """
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    best = None
    for bits in range(2, max(2, math.ceil(math.log2(max(2, rows / BUCKET_ROWS))) + 1) + 1):
        met = same ** bits + PROBES * (1 - same) * same ** (bits - 1) / 2  # at least: the bits probed are the likeliest to differ
        tables = math.ceil(math.log(1 - recall) / math.log(1 - min(met, 1 - 1e-9)))
        bucket = max(rows * 0.5 ** bits, BUCKET_ROWS)
        copies = tables * (1 + PROBES) * math.ceil(bucket / settings.BLOCK_ROWS)
        work = copies * (COPY_ROWS + min(bucket, settings.BLOCK_ROWS))  # what a row costs
        if best is None or work < best[0]:
            best = work, bits, tables
    return best[1], best[2]


def candidate_pairs(df: DataFrame, threshold: float, *, keys: list[str], id_col: str, vec_col: str, inclusive: bool = False,
                    recall: float = settings.CANDIDATE_RECALL, block_rows: int = settings.BLOCK_ROWS) -> DataFrame:
    """Similar pairs like ``similar_pairs``, without comparing all: no pair is wrong, and ``recall`` of those just at the threshold are
    expected, more above it.

    Each table codes a vector by the signs of random projections. A row enters the bucket of its code, and those
    of the codes that differ in one of its ``PROBES`` least certain signs. Only rows of one bucket are compared, in blocks, so a bucket
    of any size is spread over tasks; what a task finds over the threshold is found for good. Groups of at most ``block_rows`` are
    compared whole; buckets have blocks of their own size.

    A row takes its codes of the tables before along, so a pair is handed on where it meets first and nowhere else. Tables come in rounds of at most
    ``ROUND_COPIES`` copies of a vector: what a round lays out is gone when the next begins.
    """
    prepared = _nonzero(_prepared(df, keys, id_col, vec_col), "_vec")
    most = group_sizes(prepared, keys).agg(F.max("_rows")).first()[0] or 0
    if most <= block_rows:
        return similar_pairs(df, threshold, keys=keys, id_col=id_col, vec_col=vec_col, inclusive=inclusive, block_rows=block_rows)
    bits, tables = _tables_for(most, threshold, recall)
    probes = min(PROBES, bits)
    entry = np.dtype([("code", "<u4"), ("doubt", "u1", (probes,))])
    schema = T.StructType([prepared.schema[k] for k in keys] + [prepared.schema["_id"], prepared.schema["_vec"], T.StructField("_table", T.IntegerType()),
                                                                T.StructField("_code", T.LongType()), T.StructField("_codes", T.BinaryType())])

    def coded(first: int, last: int):
        """What lays out the tables from ``first`` to before ``last``."""
        def code(batches):
            planes: dict[int, np.ndarray] = {}
            for batch in batches:
                lengths = np.array(batch.column("_vec").value_lengths())
                for dims in np.unique(lengths).tolist():
                    rows = pa.array(np.flatnonzero(lengths == dims))
                    if dims not in planes:
                        planes[dims] = np.random.Generator(np.random.PCG64([dims, 7])).standard_normal((dims, tables * bits))[:, :last * bits]
                    step = max(1, COPY_CELLS // (last * (1 + PROBES) * max(1, dims)))
                    for at in range(0, len(rows), step):
                        yield from copies_of(pa.Table.from_batches([batch]).take(rows[at:at + step]), planes[dims])

        def copies_of(part, plane):
            cast = (matrix(part["_vec"]) @ plane).reshape(-1, last, bits)
            codes = (cast > 0) @ (np.int64(1) << np.arange(bits))
            doubtful = np.argsort(np.abs(cast), axis=2)[:, :, :probes]
            entries = np.empty((len(cast), last), entry)
            entries["code"], entries["doubt"] = codes, doubtful
            for table in range(first, last):
                own = codes[:, table, None]
                every = np.concatenate([own, own ^ (np.int64(1) << doubtful[:, table])], axis=1)
                so_far = np.ascontiguousarray(entries[:, :table + 1])
                ends = pa.array(np.arange(len(cast) + 1, dtype=np.int32) * (so_far.shape[1] * entry.itemsize))
                carried = pa.Array.from_buffers(pa.binary(), len(cast), [None, ends.buffers()[1], pa.py_buffer(so_far.tobytes())])
                again = pa.array(np.repeat(np.arange(len(cast)), every.shape[1]))
                out = part.take(again).select([f.name for f in schema][:-3])
                yield from out.append_column("_table", pa.array(np.full(len(again), table, np.int32))).append_column(
                    "_code", pa.array(every.ravel())).append_column("_codes", carried.take(again)).to_batches()

        return code

    def every_code(side, rows: np.ndarray) -> np.ndarray:
        """Of some rows the codes of each table so far, the probed ones too: rows, tables, codes."""
        held = np.frombuffer(b"".join(side["_codes"].take(pa.array(rows)).to_pylist()), entry).reshape(len(rows), -1)
        return np.concatenate([held["code"][:, :, None], held["code"][:, :, None] ^ (np.uint32(1) << held["doubt"].astype(np.uint32))], axis=2)

    def first_meeting(left, right, i, j):
        (one, i), (two, j) = (np.unique(x, return_inverse=True) for x in (i, j))
        one, two, code = every_code(left, one), every_code(right, two), left["_code"][0].as_py()
        new = np.ones(len(i), bool)
        before = one.shape[1] - 1

        def equal(some, part):
            return one[i[some]][:, part, :, None] == two[j[some]][:, part, None, :]

        for part in (slice(0, 1), slice(1, before)) if before else ():  # those that are alike meet in the first table
            open_ = np.flatnonzero(new)
            step = max(1, MEETINGS // (max(1, before) * (1 + probes) ** 2))
            for at in range(0, len(open_), step):
                some = open_[at:at + step]
                new[some] = ~equal(some, part).any(axis=(1, 2, 3))
        open_ = np.flatnonzero(new)
        same = one[i[open_], before][:, :, None] == two[j[open_], before][:, None, :]
        least = np.where(same, one[i[open_], before][:, :, None], np.uint32(0xFFFFFFFF)).min(axis=(1, 2))
        new[open_] = least == code  # two may share several codes of one table
        return new

    rows, found = prepared.select(*keys, "_id", "_vec"), []
    step = max(1, ROUND_COPIES // (1 + probes))
    for first in range(0, tables, step):
        last = min(tables, first + step)
        # a bucket where nothing but one row is has no pair; there are many of them, so a large one need not be many tasks
        met = _pairs(rows.mapInArrow(coded(first, last), schema), threshold, [*keys, "_table", "_code"], inclusive, settings.BLOCK_ROWS, first_meeting, bundles=1)
        if tables <= step:
            found.append(met)
            break
        found.append(stored(met.select(*keys, "id_a", "id_b", "sim")))
        del met
        discard(df.sparkSession)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy(*keys, "id_a", "id_b").agg(F.max("sim").alias("sim"))


def best_partner(df: DataFrame, *, keys: list[str], id_col: str, vec_col: str, block_rows: int = settings.BLOCK_ROWS) -> DataFrame:
    """``keys, id, best``: each row's highest similarity to another row of its group."""
    prepared = _prepared(df, keys, id_col, vec_col)
    schema = T.StructType([prepared.schema[k] for k in keys] + [prepared.schema["_id"], T.StructField("_best", T.DoubleType())])

    def kernel(left: pa.Table, right: pa.Table, sims: np.ndarray, same: bool) -> pa.Table:
        if same:
            sims = sims.copy()
            np.fill_diagonal(sims, -np.inf)
        sides = [(left, sims)] if same else [(left, sims), (right, sims.T)]
        return pa.concat_tables([pa.table({**{k: side[k] for k in keys}, "_id": side["_id"],
                                           "_best": pa.array(part.max(axis=1, initial=-np.inf))}) for side, part in sides])

    found = compare_blocks(prepared, keys, kernel, schema, 0.0, block_rows)
    return found.groupBy(*keys, F.col("_id").alias(id_col)).agg(F.max("_best").alias("best")).filter(F.col("best") > float("-inf"))


def local_components(hit: np.ndarray) -> np.ndarray:
    """Smallest member index of each row's component in a symmetric boolean matrix."""
    label = np.arange(hit.shape[0])
    linked = hit | np.eye(hit.shape[0], dtype=bool)
    while True:
        lowest = np.where(linked, label[None, :], hit.shape[0]).min(axis=1)
        lowest = np.minimum(lowest, lowest[lowest])
        if (lowest == label).all():
            return label
        label = lowest


def similarity_forest(df: DataFrame, threshold: float, *, keys: list[str], id_col: str, vec_col: str,
                      inclusive: bool = True, block_rows: int = settings.BLOCK_ROWS) -> DataFrame:
    """Edges ``keys, src, dst`` that connect what similarity over the threshold connects.

    Each task emits a spanning forest of its own links, so the edges stay fewer than the rows of all tasks even when
    every row of a group resembles every other.
    """
    prepared = _prepared(df, keys, id_col, vec_col)
    id_field = prepared.schema["_id"]
    schema = T.StructType([prepared.schema[k] for k in keys] + [
        T.StructField("src", id_field.dataType), T.StructField("dst", id_field.dataType)])

    def kernel(left: pa.Table, right: pa.Table, sims: np.ndarray, same: bool) -> pa.Table:
        hit = over(sims, threshold, inclusive)
        if same:
            ids, links = left["_id"], hit
            keyed = left
        else:
            nl, nr = hit.shape
            links = np.zeros((nl + nr, nl + nr), dtype=bool)
            links[:nl, nl:], links[nl:, :nl] = hit, hit.T
            ids = pa.chunked_array(left["_id"].chunks + right["_id"].chunks, type=left["_id"].type)
            keyed = pa.concat_tables([left.select(keys), right.select(keys)])
        root = local_components(links)
        member = np.nonzero(root != np.arange(len(root)))[0]
        columns = {k: keyed[k].take(pa.array(member)) for k in keys}
        return pa.table({**columns, "src": ids.take(pa.array(root[member])), "dst": ids.take(pa.array(member))})

    return compare_blocks(prepared, keys, kernel, schema, threshold, block_rows)


def peer_support(df: DataFrame, threshold: float, *, keys: list[str], id_col: str, vec_col: str, source_col: str,
                 block_rows: int = settings.BLOCK_ROWS) -> DataFrame:
    """Per row: the sum and number of similarities over the threshold to rows of another source."""
    prepared = _prepared(df, keys, id_col, vec_col, _source=source_col)
    schema = T.StructType([prepared.schema[k] for k in keys] + [
        prepared.schema["_id"], T.StructField("_sum", T.DoubleType()), T.StructField("_matches", T.LongType())])

    def kernel(left: pa.Table, right: pa.Table, sims: np.ndarray, same: bool) -> pa.Table:
        ls, rs = np.array(left["_source"].to_pylist(), object), np.array(right["_source"].to_pylist(), object)
        hit = (sims > threshold) & (ls[:, None] != rs[None, :])
        parts = [(left, np.where(hit, sims, 0.0).sum(axis=1), hit.sum(axis=1))]
        if not same:
            parts.append((right, np.where(hit, sims, 0.0).sum(axis=0), hit.sum(axis=0)))
        tables = []
        for side, total, matches in parts:
            some = np.nonzero(matches)[0]
            tables.append(pa.table({**{k: side[k].take(pa.array(some)) for k in keys}, "_id": side["_id"].take(pa.array(some)),
                                    "_sum": pa.array(total[some]), "_matches": pa.array(matches[some].astype(np.int64))}))
        return pa.concat_tables(tables)

    partial = compare_blocks(prepared, keys, kernel, schema, threshold, block_rows)
    return partial.groupBy(*keys, F.col("_id").alias(id_col)).agg(
        F.sum("_sum").alias("peer_sum"), F.sum("_matches").alias("peer_matches"))


def best_query_similarity(docs: DataFrame, queries: DataFrame, *, key: str, id_col: str, vec_col: str,
                          query_vec: str = "vec", broadcast_bytes: int = settings.QUERY_BROADCAST_BYTES,
                          chunk_rows: int = 4 * settings.BLOCK_ROWS) -> DataFrame:
    """Per document the highest cosine to any query of its session: ``key, id, relevance_score``.

    When all queries together are small they are sent to every task and the documents stay where they are. Otherwise
    documents and queries meet by session, a large session in several chunks.
    """
    q = queries.select(key, F.col(query_vec).cast("array<double>").alias("_q")).filter(F.col("_q").isNotNull())
    d = docs.select(key, id_col, F.col(vec_col).cast("array<double>").alias("_vec"))
    schema = T.StructType([d.schema[key], d.schema[id_col], T.StructField("relevance_score", T.DoubleType())])
    size = q.agg(F.coalesce(F.sum(F.size("_q")), F.lit(0)).alias("n")).first()["n"] * 8

    def best(vectors: np.ndarray, against: np.ndarray) -> np.ndarray:
        return (unit_rows(vectors) @ unit_rows(against).T).max(axis=1)

    if size <= broadcast_bytes:
        def by_group(names: list) -> dict:
            rows: dict = {}
            for at, g in enumerate(names):
                rows.setdefault(g, []).append(at)
            return rows

        asked = q.toArrow().combine_chunks()
        shared = docs.sparkSession.sparkContext.broadcast(
            {g: matrix(asked["_q"].take(pa.array(rows))) for g, rows in by_group(asked[key].to_pylist()).items()})

        def scan(batches):
            for batch in batches:
                table = pa.Table.from_batches([batch])
                score = np.full(table.num_rows, np.nan)
                for g, rows in by_group(table[key].to_pylist()).items():
                    if g in shared.value:
                        score[rows] = best(matrix(table["_vec"].take(pa.array(rows))), shared.value[g])
                keep = pa.array(np.nonzero(~np.isnan(score))[0])
                out = pa.table({key: table[key].take(keep), id_col: table[id_col].take(keep),
                                "relevance_score": pa.array(score).take(keep)})
                yield from out.to_batches()

        return d.mapInArrow(scan, schema)

    # either side of a session may be large: every chunk of documents meets every chunk of queries, best scores are kept
    chunks = lambda df, name: df.groupBy(key).agg(F.ceil(F.count("*") / F.lit(chunk_rows)).cast("int").alias(name))
    sizes = chunks(d, "_dn").join(chunks(q, "_qn"), key)
    place = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = d.join(sizes, key).withColumn("_dc", place(id_col, "_dn")).withColumn("_qc", every("_qn"))
    right = q.join(sizes, key).withColumn("_qc", place("_q", "_qn")).withColumn("_dc", every("_dn"))

    def meet(docs_: pa.Table, queries_: pa.Table) -> pa.Table:
        if docs_.num_rows == 0 or queries_.num_rows == 0:
            docs_ = docs_.slice(0, 0)
            score = pa.array([], pa.float64())
        else:
            score = pa.array(best(matrix(docs_["_vec"]), matrix(queries_["_q"])))
        return pa.table({key: docs_[key], id_col: docs_[id_col], "relevance_score": score})

    met = left.groupBy(key, "_dc", "_qc").cogroup(apart(right).groupBy(key, "_dc", "_qc")).applyInArrow(meet, schema)
    return met.groupBy(key, id_col).agg(F.max("relevance_score").alias("relevance_score"))


def vector_search(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", *, id_col: str, vec_col: str,
                  query_id: str = "query_id", query_vec: str = "query_vec",
                  broadcast_bytes: int = settings.QUERY_BROADCAST_BYTES, chunk_rows: int = 4 * settings.BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest corpus rows of every query: ``query_id, id, distance, similarity, rank``.

    Queries of at most ``broadcast_bytes`` together travel, and the corpus does not: each task keeps the ``k`` best of its own
    rows per query. Otherwise chunks of the corpus and of the queries meet pairwise, and each meeting gives its ``k`` best.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("_q"))
    corpus_ = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("_vec"))
    size = q.agg(F.coalesce(F.sum(F.size("_q")), F.lit(0)).alias("n")).first()["n"] * 8
    schema = T.StructType([q.schema["query_id"], corpus_.schema["id"], T.StructField("distance", T.DoubleType())])
    nearest = _nearest(k, metric)
    if size == 0:
        found = corpus.sparkSession.createDataFrame([], schema)
    elif size <= broadcast_bytes:
        shared = corpus.sparkSession.sparkContext.broadcast(q.toArrow())

        def scan(batches):
            for batch in batches:
                if batch.num_rows:
                    yield from nearest(pa.Table.from_batches([batch]), shared.value).to_batches()

        found = corpus_.mapInArrow(scan, schema)
    else:
        chunks = [max(1, math.ceil(df.count() / chunk_rows)) for df in (corpus_, q)]
        place = lambda of, n: F.pmod(F.xxhash64(of), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = corpus_.withColumn("_cc", place("id", chunks[0])).withColumn("_qc", every(chunks[1]))
        right = q.withColumn("_qc", place("query_id", chunks[1])).withColumn("_cc", every(chunks[0]))
        empty = pa.table({"query_id": [], "id": [], "distance": []})

        def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
            if rows.num_rows == 0 or asked.num_rows == 0:
                return pa.table({"query_id": asked["query_id"].slice(0, 0), "id": rows["id"].slice(0, 0), "distance": empty["distance"].cast(pa.float64())})
            return nearest(rows, asked)

        found = left.groupBy("_cc", "_qc").cogroup(apart(right).groupBy("_cc", "_qc")).applyInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")).withColumn("similarity", 1 - F.col("distance")))


def _nearest(k: int, metric: str):
    """Of the rows of one table the ``k`` nearest to each query of another, as ``query_id, id, distance``."""
    def distances(vectors: np.ndarray, against: np.ndarray) -> np.ndarray:
        if metric == "cosine":
            return 1.0 - unit_rows(against) @ unit_rows(vectors).T
        if metric == "dot":
            return 1.0 - against @ vectors.T
        square = (against ** 2).sum(1)[:, None] + (vectors ** 2).sum(1)[None, :] - 2.0 * against @ vectors.T
        return np.maximum(square, 0.0)

    def best_of(rows: pa.Table, vectors: np.ndarray, asked: pa.Table) -> pa.Table:
        dist = distances(vectors, matrix(asked["_q"]))
        best = np.argsort(dist, axis=1, kind="stable")[:, :k]
        qi = np.repeat(np.arange(asked.num_rows), best.shape[1])
        return pa.table({"query_id": asked["query_id"].take(pa.array(qi)), "id": rows["id"].take(pa.array(best.ravel())),
                         "distance": pa.array(dist[qi, best.ravel()])})

    def nearest(rows: pa.Table, asked: pa.Table) -> pa.Table:
        # distances of a strip of queries at a time: what a task holds does not grow with the queries
        rows = rows.sort_by("id")
        vectors, step = matrix(rows["_vec"]), max(1, STRIP_CELLS // max(1, rows.num_rows))
        return pa.concat_tables([best_of(rows, vectors, asked.slice(at, step)) for at in range(0, max(1, asked.num_rows), step)])

    return nearest
