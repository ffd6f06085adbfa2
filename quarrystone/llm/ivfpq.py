"""Problem 2: the most similar vectors of every binary vector.

A two-level coarse quantiser (regions, and lists within each region) holds every
different vector once, with the product-quantised residual to its list's
centroid. A query visits its nearest lists in its nearest regions; there,
asymmetric distance tables tell which entries can be as similar as asked for,
and the nearest of these are ranked again by exact Tanimoto similarity.
Centroids and codebooks are fitted on a bounded sample drawn by hash (at most
SAMPLE vectors); every vector is indexed and every vector is a query.

The more lists there are, the likelier two similar vectors lie in lists that do
not visit each other. So what is found is closed once: entries that found the
same one are compared with each other exactly, whatever lists they are in.

Equal vectors are one entry that knows its smallest ids, so copies cost nothing
and none is lost. What is shipped of a query is one line per region it visits.
Regions are cut into blocks of entries and of queries, so a region that holds a
third of all vectors is searched by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.sources.tables import cut

SAMPLE = 262_144  # vectors the quantisers are fitted on, at most; 8 a list and 40,960 where the lists need no more
LEAST_SAMPLE = 40_960
SUBSPACES = 8
CODES = 64
CELLS = 262_144  # pairs of entries and queries looked at a time
FEW = 0.05  # share of such pairs up to which they are ranked again one by one and not as a matrix
BLOCK = 65_536  # entries of a region's block
QUERIES = 65_536  # queries of a region's block
REGIONS = 24  # visited by a query, at most
VISITED = 384  # lists of which a query visits one, where that is more than asked for
WIDE = 2  # times k others of an entry are kept until what is found is closed
AROUND = 32  # nearest of those that found one entry are compared with each other
SCALE = 64.0  # steps of a squared distance of 1 in the integer tables


def pack_vectors(df: DataFrame, id_: str, vector: str, length: int) -> DataFrame:
    """(id, bits) of the usable rows: vectors of `length` elements, none NULL or NaN, not all zero; elements above 0.5 are ones."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            right = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(-1)) == length)
            flat = lists.take(pa.array(right)).flatten()
            rows = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, length)
            ones = rows > 0.5
            good = ~np.isnan(rows).any(1) & ones.any(1)
            bits = np.packbits(ones[good], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right[good])).cast(pa.int64()), _binary(bits)], names=["id", "bits"])

    return df.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where("id IS NOT NULL").mapInArrow(pack, "id long, bits binary")


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _bits(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The bytes of a binary column as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _floats(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Indexes of the k nearest centres of each row, nearest first."""
    half = (centres * centres).sum(1) / 2
    out = np.empty((len(x), k), np.int32)
    for a in range(0, len(x), 2048):
        d = half[None] - x[a : a + 2048] @ centres.T
        if k == 1:
            out[a : a + 2048, 0] = d.argmin(1)
        else:
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            out[a : a + 2048] = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centres of the rows of x by Lloyd's rounds; empty centres are drawn anew."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)[:, 0]
        order = at.argsort(kind="stable")
        filled, first, n = np.unique(at[order], return_index=True, return_counts=True)
        centres[filled] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
        empty = np.setdiff1d(np.arange(k), filled)
        if len(empty):
            centres[empty] = x[rng.integers(0, len(x), len(empty))]
    return centres.astype(np.float32)


class Index:
    """The quantisers: regions, lists (grouped by region, region r has first[r] .. first[r + 1] - 1), codebooks, and how far estimates of squared distances may lie above the truth."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 11):
        x = _floats(sample)
        wanted = max(1, min(int(2 ** np.round(np.log2(4 * np.sqrt(max(n, 1))))), len(x) // 4))
        self.regions = _kmeans(x, max(1, int(2 ** np.ceil(np.log2(wanted) / 2))), 8, seed)
        at = _nearest(x, self.regions)[:, 0]
        parts, first = [], [0]
        for r in range(len(self.regions)):
            mine = x[at == r]
            k = min(len(mine), max(1, round(wanted * len(mine) / len(x))))
            parts.append(_kmeans(mine, k, 6, seed + r) if k else self.regions[r : r + 1])
            first.append(first[-1] + len(parts[-1]))
        self.lists, self.first = np.concatenate(parts), np.array(first)
        self.step = x.shape[1] // SUBSPACES
        own = self.visit(x, 1)[:, 0]
        residual = x - self.lists[own]
        k = max(1, min(CODES, len(x)))
        self.books = np.stack([_kmeans(np.ascontiguousarray(residual[:, m * self.step : (m + 1) * self.step]), k, 5, seed + m + 1) for m in range(SUBSPACES)])
        # The estimate is furthest off for near pairs: those of a vector and its nearest in the sample.
        asked, held = slice(0, min(512, len(x))), slice(0, min(16_384, len(x)))
        true = _squared(x[asked], x[held])
        true[true < 0.5] = np.inf
        other = true.argmin(1)
        near = self.lists[own[other]] + self.decode(self.encode(x[other], own[other]))
        gap = ((x[asked] - near) ** 2).sum(1) - true[np.arange(len(other)), other]
        self.margin = float(np.quantile(gap[np.isfinite(gap)], 0.995)) if np.isfinite(gap).any() else np.inf

    @classmethod
    def of(cls, state: dict) -> Index:
        """The index with the given attributes: what is broadcast is plain arrays, as workers need no copy of this package."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def visit(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each row, nearest first, in its nearest regions; -1 where these have fewer."""
        lot = min(REGIONS if probes > 1 else 2, len(self.regions))
        regions = _nearest(x, self.regions, lot)
        most = int(np.diff(self.first).max())
        far = np.full((len(x), lot * most), np.inf, np.float32)
        for r in np.unique(regions):
            a, b = self.first[r], self.first[r + 1]
            rows, slot = np.nonzero(regions == r)
            far[rows[:, None], slot[:, None] * most + np.arange(b - a)[None]] = (self.lists[a:b] ** 2).sum(1)[None] / 2 - x[rows] @ self.lists[a:b].T
        k = min(probes, far.shape[1])
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        d = np.take_along_axis(far, near, 1)
        order = d.argsort(1, kind="stable")
        near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
        names = self.first[np.take_along_axis(regions, near // most, 1)] + near % most
        return np.where(np.isfinite(d), names, -1).astype(np.int32)

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        residual = x - self.lists[own]
        return np.stack([_nearest(residual[:, m * self.step : (m + 1) * self.step], self.books[m])[:, 0] for m in range(SUBSPACES)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[m][codes[:, m]] for m in range(SUBSPACES)], axis=1)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """The asymmetric tables of the queries: (subspace, code, query) inner products with the codebooks; they serve all lists."""
        return np.stack([self.books[m] @ x[:, m * self.step : (m + 1) * self.step].T for m in range(SUBSPACES)])


def _visits(index: Index, near: np.ndarray) -> pa.Array:
    """Per row of visited lists (-1 for none): (region, its visited lists numbered within it) of each region."""
    lists = np.sort(near, axis=1)
    region = np.searchsorted(index.first, lists, side="right") - 1
    real = lists >= 0
    opens = real & (np.diff(region, axis=1, prepend=-2) != 0)
    flat, starts = (lists - index.first[region])[real].astype(np.int16), np.flatnonzero(opens[real])
    inner = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)).astype(np.int32)), pa.array(flat))
    pairs = pa.StructArray.from_arrays([pa.array(region[opens].astype(np.int32)), inner], names=["region", "lists"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(opens.sum(1))).astype(np.int32)), pairs)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


class _Block:
    """Entries of a region's block, in order of their lists."""

    def __init__(self, index: Index, lists: np.ndarray, ids: np.ndarray, bits: np.ndarray, codes: np.ndarray):
        order = np.argsort(lists, kind="stable")
        self.index, self.lists, self.ids = index, lists[order], ids[order]
        self.codes, self.rooms = codes[order], {}
        self.words = np.ascontiguousarray(bits[order]).view(np.uint64)
        self.wide = np.ascontiguousarray(self.words.T)
        self.ones = np.bitwise_count(self.words).sum(1).astype(np.int32)
        near = index.decode(self.codes)
        self.bias = np.rint(((near * near).sum(1) + 2 * (near * index.lists[self.lists]).sum(1)) * SCALE).astype(np.int32)

    def search(self, at: np.ndarray, q_list: np.ndarray, q_id: np.ndarray, q_bits: np.ndarray, k: int, least: float):
        """(query id, entry id, similarity) of the k best entries of each query among its lists, at least `least` similar, ties to smaller ids. at, q_list: which query visits which list."""
        x, words = _floats(q_bits), np.ascontiguousarray(q_bits).view(np.uint64)
        ones = np.bitwise_count(words).sum(1).astype(np.int32)
        # |q - x|^2 is |q or x| - |q and x|; of at least the similarity t it is at most (1 - t) / t of q's ones.
        bound = (1 - least) / least * ones + self.index.margin if least > 0 else np.full(len(ones), np.inf)
        self.least, found = max(least, 0.0), []
        order = np.argsort(q_list, kind="stable")
        at, q_list = at[order], q_list[order]
        names, starts = np.unique(q_list, return_index=True)
        for name, queries in zip(names, np.split(at, starts[1:]), strict=True):
            a, b = np.searchsorted(self.lists, [name, name + 1])
            if a == b:
                continue
            centre = self.index.lists[name]
            lot = min(1024, max(8, CELLS // (b - a)))
            for rows in np.split(queries, range(lot, len(queries), lot)):
                found.append(self._one_list(a, b, x[rows], words, ones, rows, centre, bound[rows]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        qi, di, alike = (np.concatenate(f) for f in zip(*found, strict=True))
        keep = q_id[qi] != self.ids[di]
        qi, di, alike = qi[keep], di[keep], alike[keep]
        order = np.lexsort((self.ids[di], -alike, qi))
        qi, di, alike = qi[order], di[order], alike[order]
        start = np.flatnonzero(np.diff(qi, prepend=-1))
        place = np.arange(len(qi)) - np.repeat(start, np.diff(np.append(start, len(qi))))
        best = place < k
        return q_id[qi[best]], self.ids[di[best]], alike[best]

    def _room(self, kind, shape: tuple[int, int], slot: int) -> np.ndarray:
        """An array that is used again by every call."""
        n = shape[0] * shape[1]
        if slot not in self.rooms or len(self.rooms[slot]) < n:
            self.rooms[slot] = np.empty(max(n, 2 * CELLS), kind)
        return self.rooms[slot][:n].reshape(shape)

    def _one_list(self, a, b, x, words, ones, rows, centre, bound):
        """(query, entry, similarity) of the entries a .. b of one list that the tables let be similar enough to each of the queries `rows`."""
        tables = np.rint(self.index.tables(x) * (-2 * SCALE)).astype(np.int32)
        shape = (b - a, len(rows))
        far, step = self._room(np.int32, shape, 0), self._room(np.int32, shape, 1)
        far[:] = self.bias[a:b, None]
        for m in range(SUBSPACES):
            np.take(tables[m], self.codes[a:b, m], axis=0, out=step, mode="clip")
            far += step
        limit = np.clip((bound - ((x - centre) ** 2).sum(1)) * SCALE, -(2.0**30), 2.0**30).astype(np.int32)
        near = far <= limit[None]
        if np.count_nonzero(near) > FEW * near.size:
            # Many pairs may qualify: count the common ones of all of them word by word.
            # Up to 256 bits a count fits a byte: only equal vectors, which are one entry, have more in common than 255.
            kind = np.uint8 if words.shape[1] <= 4 else np.uint16
            both, hits, shared = self._room(kind, shape, 2), self._room(np.uint8, shape, 3), self._room(np.uint64, shape, 4)
            for w in range(words.shape[1]):
                np.bitwise_and(self.wide[w, a:b, None], words[rows, w][None], out=shared)
                np.bitwise_count(shared, out=hits)
                both[:] = hits if w == 0 else both + hits
            # Similarity t asks for t / (1 + t) of the ones of both sides; rounded down here, exact below.
            half = lambda n: np.minimum(np.floor(n * (self.least / (1 + self.least)) - 1e-9).clip(0), np.iinfo(kind).max // 2).astype(kind)
            near &= both >= half(self.ones[a:b])[:, None] + half(ones[rows])[None]
        di, qi = np.divmod(np.flatnonzero(near), len(rows))
        di, qi = di + a, rows[qi]
        both = np.bitwise_count(words[qi] & self.words[di]).sum(1, dtype=np.int32)
        alike = both / (ones[qi] + self.ones[di] - both)
        keep = alike >= self.least
        return qi[keep], di[keep], alike[keep]


def _closed(near: DataFrame, entries: DataFrame, k: int, least: float, width: int) -> DataFrame:
    """(entry, other, similarity) that (entry, other, similarity, place) lacks and that belong to an entry's k best: of two entries that have a third one in common."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                groups = batch.column(0).slice(a, 1024)
                sizes, flat = np.asarray(groups.value_lengths()), groups.flatten()
                first = np.cumsum(sizes) - sizes
                entry, floor = flat.field("entry").to_numpy(), flat.field("floor").to_numpy()
                words = np.ascontiguousarray(_bits(flat.field("bits"), width)).view(np.uint64)
                ones = np.bitwise_count(words).sum(1).astype(np.int32)
                lists = flat.field("known")
                known, n = np.repeat(entry[:, None], k, 1), np.asarray(lists.value_lengths())
                known[np.arange(k)[None] < n[:, None]] = lists.flatten().to_numpy()
                for size in np.unique(sizes[sizes > 1]):
                    i, j = np.triu_indices(size, 1)
                    at = first[sizes == size][:, None]
                    i, j = (at + i).ravel(), (at + j).ravel()
                    both = np.bitwise_count(words[i] & words[j]).sum(1, dtype=np.int32)
                    alike = both / (ones[i] + ones[j] - both)
                    found = []
                    for p, q in ((i, j), (j, i)):
                        new = np.flatnonzero((alike >= least) & (alike >= floor[p]))
                        new = new[(known[p[new]] != entry[q[new], None]).all(1)]
                        found.append((entry[p[new]], entry[q[new]], alike[new]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in zip(*found, strict=True)], names=["entry", "other", "similarity"])

    lists = near.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("place", "other", "similarity"))).alias("near"))
    floor = F.when(F.size("near") >= k, F.col("near")[k - 1]["similarity"]).otherwise(-1.0)
    told = lists.join(entries.select("entry", "bits"), "entry").select("entry", "bits", F.slice("near.other", 1, k).alias("known"), floor.alias("floor"), F.explode("near").alias("v"))
    place = F.row_number().over(Window.partitionBy("v.other").orderBy(F.desc("v.similarity"), "entry"))
    around = told.withColumn("r", place).where(F.col("r") <= AROUND).groupBy(F.col("v.other").alias("centre")).agg(F.collect_list(F.struct("entry", "bits", "known", "floor")).alias("g"))
    return around.select("g").mapInArrow(compare, "entry long, other long, similarity double")


def most_similar(packed: DataFrame, k: int = 5, least: float = 0.0, probes: int = 24, length: int = 256) -> tuple[DataFrame, DataFrame]:
    """(entries, neighbours) of a (id, bits) table.

    entries: (entry, bits, ids, n_listed): each different vector with its
    smallest k+1 ids, named by the smallest. neighbours: (entry, other, similarity, place): the k
    most similar other entries of each entry with Tanimoto similarity >= least,
    ties won by the smaller id, among those its lists (`probes`, more where
    there are many) shortlist or those that share a found entry with it.
    Entries with k+1 or more copies need no neighbours and are not queries.
    Rows repeated under one id count once. An empty table gives empty results.
    """
    width = length // 8
    first = F.row_number().over(Window.partitionBy("bits").orderBy("id"))
    few = packed.distinct().withColumn("r", first).where(F.col("r") <= k + 1)
    entries = cut(few.groupBy("bits").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "bits", "ids", F.size("ids").alias("n_listed")))
    spark = packed.sparkSession
    n = entries.count()
    size = int(min(SAMPLE, max(LEAST_SAMPLE, 32 * np.sqrt(n))))
    sample = entries.select("entry", "bits").orderBy(F.xxhash64("entry"), "entry").limit(size).select("bits").collect()
    schema = "entry long, other long, similarity double"
    if not sample:
        return entries, spark.createDataFrame([], schema + ", place int")
    index = Index(np.frombuffer(b"".join(bytes(r[0]) for r in sample), np.uint8).reshape(-1, width), n)
    model = spark.sparkContext.broadcast(vars(index))
    probes, wide = max(probes, len(index.lists) // VISITED), WIDE * k

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(model.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = _floats(_bits(part.column(1), width))
                near = index.visit(x, probes)
                own = near[:, 0]
                region = np.searchsorted(index.first, own, side="right") - 1
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(region.astype(np.int32)), pa.array(own), _binary(index.encode(x, own)), _visits(index, near)], names=["entry", "bits", "n_listed", "region", "own", "code", "visits"])

    indexed = cut(entries.select("entry", "bits", "n_listed").mapInArrow(assign, "entry long, bits binary, n_listed int, region int, own int, code binary, visits array<struct<region:int,lists:array<short>>>"))
    asking = indexed.where(F.col("n_listed") <= k).select("entry", "bits", F.explode("visits").alias("v")).select("entry", "bits", "v.region", "v.lists")
    held = indexed.select("region", "entry", "bits", "code", "own")
    parts = lambda n: F.ceil(F.count("*") / n).cast("int")
    blocks = cut(held.groupBy("region").agg(parts(BLOCK).alias("d_blocks")).join(asking.groupBy("region").agg(parts(QUERIES).alias("q_blocks")), "region"))  # one row a region
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("entry"), F.col(c)).cast("int")
    held = held.join(F.broadcast(blocks), "region").select("region", own("d_blocks").alias("d"), span("q_blocks").alias("q"), "entry", "bits", "code", "own")
    asking = asking.join(F.broadcast(blocks), "region").select(F.col("region").alias("q_region"), own("q_blocks").alias("q_q"), span("d_blocks").alias("q_d"), F.col("entry").alias("q_entry"), F.col("bits").alias("q_bits"), F.col("lists").alias("q_lists"))
    out = pa.schema([("entry", pa.int64()), ("other", pa.int64()), ("similarity", pa.float64())])

    def search(key, entries_: pa.Table, queries: pa.Table) -> pa.Table:
        if not entries_.num_rows or not queries.num_rows:
            return out.empty_table()
        index = Index.of(model.value)
        block = _Block(index, entries_.column("own").to_numpy(), entries_.column("entry").to_numpy(), _bits(entries_.column("bits"), width), _bits(entries_.column("code"), SUBSPACES))
        lists = queries.column("q_lists").combine_chunks()
        at, name = np.asarray(pa.compute.list_parent_indices(lists)), np.asarray(lists.flatten()).astype(np.int64) + index.first[key[0].as_py()]
        found = block.search(at, name, queries.column("q_entry").to_numpy(), _bits(queries.column("q_bits"), width), wide, least)
        # What a query finds is told to the entry found as well, which may not have visited the query's list.
        q, e, alike = found
        return pa.Table.from_arrays([pa.array(np.concatenate(f)) for f in ((q, e), (e, q), (alike, alike))], schema=out)

    near = held.groupBy("region", "d", "q").cogroup(asking.groupBy("q_region", "q_d", "q_q")).applyInArrow(search, schema)
    place = F.dense_rank().over(Window.partitionBy("entry").orderBy(F.desc("similarity"), "other"))
    best = lambda df, n: df.withColumn("place", place).where(F.col("place") <= n).dropDuplicates(["entry", "other"])
    near = cut(best(near, wide))
    more = _closed(near, entries, k, least, width)
    return entries, best(near.where(F.col("place") <= k).drop("place").unionByName(more), k)


def similar_pairs(packed: DataFrame, k: int = 5, least: float = 0.0, probes: int = 24, length: int = 256) -> DataFrame:
    """(a, b) with a < b: ids of which at least one has the other among its k most similar others of similarity >= least, ties won by the smaller id."""
    packed = cut(packed)
    entries, near = most_similar(packed, k, least, probes, length)
    # Copies of one vector: every member with the k smallest others of its own entry.
    several = entries.where("n_listed > 1").select("bits", "ids")
    members = packed.distinct().join(several, "bits")
    others = F.filter("ids", lambda x: x != F.col("id"))
    copies = members.select("id", F.explode(F.slice(others, 1, k)).alias("other"))
    # Other entries: their ids in order of similarity, as many as the copies leave room for.
    named = near.join(entries.select(F.col("entry").alias("other"), F.col("ids").alias("other_ids")), "other").select("entry", "similarity", F.explode("other_ids").alias("other"))
    place = F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("similarity"), "other"))
    ranked = named.withColumn("place", place).where(F.col("place") <= k)
    apart = ranked.join(entries.select("entry", "ids", "n_listed"), "entry").where(F.col("place") <= k - F.col("n_listed") + 1).select(F.explode("ids").alias("id"), "other")
    both = apart.unionByName(copies) if least <= 1 else apart
    return both.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
