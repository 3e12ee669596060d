"""MinHash near-dedup with DartMinHash signatures.

A document is a weighted set of shingles. Darts are thrown at random into the plane of weight and
rank; a dart belongs to an element, lies in its region if its weight coordinate is below the
element's weight, and names one of ``K`` coordinates. A coordinate's value is the rank of its
earliest dart. Regions are cut into cells whose darts depend on the element and the cell only, and
only cells below a rank that the document's total weight calls for are filled, so a long document costs
about one hash a shingle.

Signatures are cut into bands; an equi-join on bands gives candidate pairs, whose similarity is then
computed exactly from the shingle sets. Documents with equal sets are one node from the start, so
copies are never paired with each other. Classes are the connected components of the links.

A bucket of many nodes doesn't give all its pairs. Its nodes are paired with its central node, and a node
that ends up in another component than the centre is joined with the nodes of large buckets that are in
other components, on the rarest shingles of either and only where sizes and places allow enough
overlap: sets that overlap enough meet so, and no link is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, release_memory, text_of, work_table
from .textwords import Words, chunks, mix64

SHINGLE = 5
SIMILARITY = 0.8
K = 128
BAND_ROWS = 4
SALTS = 64
#: Buckets up to this size give all their pairs; larger ones are linked through their central document, and what that
#: leaves open is joined exactly, by prefixes of rare shingles.
PAIR_BUCKET = 32
#: Rounds in which sets of large buckets that cannot be linked are left out before their shingles are joined.
PRUNINGS = 2
#: So many of the most frequent shingles are told to all tasks; they come last in the order of shingles.
LISTED = 1 << 20
BASE_RANK = 0.5
SLICE_BYTES = 1 << 19


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, times) of each text's distinct shingles, by row and hash; a shorter text is one shingle."""
    words = Words(texts)
    first, h = words.windows(width)
    row = words.doc[first]
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    begins = np.concatenate(([0], np.cumsum(words.count)))
    if len(short):
        own = [mix64(np.array([int(np.bitwise_xor.reduce(mix64(words.hash[begins[i] : begins[i + 1]] + np.arange(words.count[i], dtype=np.uint64))))], np.uint64))[0] for i in short]
        row, h = np.append(row, short), np.append(h, np.array(own, np.uint64))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(u: np.ndarray, area: float) -> np.ndarray:
    """How many darts a cell of this area gets, by a uniform number."""
    n = int(area + 12 * np.sqrt(area) + 16)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n)))))
    total = np.cumsum(np.exp(np.arange(n) * np.log(area) - area - logs))
    return np.searchsorted(total, u, "right")


def _throw(out: np.ndarray, row: np.ndarray, h: np.ndarray, weight: np.ndarray, strip: int) -> None:
    """Throw the darts of one strip of ranks and keep the earliest for each coordinate."""
    low, high = (0.0, BASE_RANK) if strip == 0 else (BASE_RANK * 2.0 ** (strip - 1), BASE_RANK * 2.0**strip)
    cell, reach = 0, 0.0
    while len(h):
        end = 1.0 if cell == 0 else reach * 2
        seed = mix64(h ^ np.uint64((strip << 32 | cell) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        n = _poisson(_uniform(mix64(seed + np.uint64(1))), (high - low) * (end - reach))
        at = np.repeat(np.arange(len(h)), n)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix64(seed[at] + (nth.astype(np.uint64) + np.uint64(2)) * np.uint64(0xD1B54A32D192ED03))
        inside = reach + _uniform(mix64(dart ^ np.uint64(0x5851F42D4C957F2D))) * (end - reach) < weight[at]
        at, dart = at[inside], dart[inside]
        rank = low + _uniform(dart) * (high - low)
        coordinate = (mix64(dart ^ np.uint64(0x14057B7EF767814F)) % np.uint64(K)).astype(np.int64)
        np.minimum.at(out, (row[at], coordinate), rank)
        more = weight > end
        row, h, weight, cell, reach = row[more], h[more], weight[more], cell + 1, end


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x K earliest ranks; rows without elements stay at infinity."""
    out = np.full((n, K), np.inf)
    total = np.bincount(row, weights=weight, minlength=n)
    strips = np.zeros(n, np.int64)
    full = total > 0
    strips[full] = np.maximum(0, np.ceil(np.log2((np.log(K) + 2) * K / total[full] / BASE_RANK)))
    strip, lacking = 0, full.copy()
    while lacking.any():
        pick = lacking[row]
        _throw(out, row[pick], h[pick], weight[pick], strip)
        strip += 1
        lacking = full & ((strips >= strip) | np.isinf(out).any(axis=1))
    return out


def _bands(out: np.ndarray) -> np.ndarray:
    """n x (K / BAND_ROWS) band keys, a band's number included."""
    bits = out.view(np.uint64).reshape(len(out), -1, BAND_ROWS)
    total = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2]).copy()
    for j in range(BAND_ROWS):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, j])
    return total.view(np.int64)


def _node(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text a hash of its shingle set, and the set's size."""
    size = np.bincount(row, minlength=n)
    total = np.zeros(n, np.uint64)
    np.add.at(total, row, mix64(h ^ np.uint64(0xA0761D6478BD642F)))
    return mix64(total + size.astype(np.uint64)).view(np.int64), size


def sketch(docs: DataFrame, weighting: str = "set") -> DataFrame:
    """(doc_id, node, n, bands) of (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, limit=SLICE_BYTES):
                row, h, times = shingles(part.column(1))
                node, size = _node(row, h, part.num_rows)
                weight = times.astype(np.float64) if weighting == "count" else np.ones(len(h))
                keys = _bands(signatures(row, h, weight, part.num_rows))
                offsets = pa.array(np.arange(part.num_rows + 1) * keys.shape[1], pa.int32())
                bands = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node), pa.array(size.astype(np.int64)), bands], ["doc_id", "node", "n", "bands"])
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n long, bands array<long>")


def _pairs(members: DataFrame, key: list[str], least: float) -> DataFrame:
    a, b = members.alias("a"), members.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    near = (F.col("a.node") < F.col("b.node")) & (F.col("a.n") >= F.col("b.n") * least) & (F.col("b.n") >= F.col("a.n") * least)
    cond = near
    for s in same:
        cond = s & cond
    return a.join(b, cond).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def salted_join(rows: DataFrame, told: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows join told (one row a key) on ``key``, where one key may have very many rows: what is told about a
    key first goes to each (key, salt) in use, by the distinct ones, and from there to the rows of that salt."""
    salt = F.pmod(F.xxhash64(F.lit(5), by), F.lit(SALTS)).cast("int").alias("__salt")
    used = rows.select(key, salt).distinct().join(told, key)
    return rows.select("*", salt).join(used, [key, "__salt"], how).drop("__salt")


def live_bands(nodes: DataFrame) -> DataFrame:
    """(band, node, n, m): the bands that two nodes or more share; ``nodes``: (node, n, bands)."""
    held = nodes.select("node", "n", F.explode("bands").alias("band"))
    sizes = held.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return salted_join(held, sizes, "band", "node").select("band", "node", "n", "m")


def centres(large: DataFrame) -> DataFrame:
    """(band, centre, cn): of a large bucket's nodes the one in the fullest buckets, which is the likely original
    of the others and the same in most of their buckets."""
    known = large.withColumn("fame", F.sum("m").over(Window.partitionBy("node")))
    return known.groupBy("band").agg(F.max(F.struct("fame", "node", "n")).alias("c")).select("band", F.col("c.node").alias("centre"), F.col("c.n").alias("cn"))


def candidate_pairs(live: DataFrame, centre: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Distinct pairs (a < b): all pairs of the small buckets, and each node of a large one with its centre."""
    small, large = live.where(F.col("m") <= PAIR_BUCKET), live.where(F.col("m") > PAIR_BUCKET)
    star = salted_join(large, centre, "band", "node").where((F.col("node") != F.col("centre")) & (F.col("n") >= F.col("cn") * least) & (F.col("cn") >= F.col("n") * least))
    return _pairs(small, ["band"], least).unionByName(star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))).distinct()


def open_nodes(live: DataFrame, centre: DataFrame, comps: DataFrame) -> DataFrame:
    """Nodes of large buckets that are not in the component of each bucket's centre."""
    of_centre = centre.join(comps.withColumnsRenamed({"node": "centre", "comp": "c_comp"}), "centre", "left")
    of_centre = of_centre.select("band", F.coalesce("c_comp", "centre").alias("c_comp"))
    large = salted_join(live.where(F.col("m") > PAIR_BUCKET).select("band", "node"), of_centre, "band", "node")
    own = large.join(comps, "node", "left").where(F.coalesce("comp", "node") != F.col("c_comp"))
    return own.select("node").distinct()


def _reach(n: str, place: str, least: float) -> F.Column:
    """The largest set that one of n shingles can overlap enough, if all they share comes from ``place`` on."""
    return F.floor((F.col(n) - F.col(place)) * ((1 + least) / least) - F.col(n) + 1e-6)


def _able(there: DataFrame) -> DataFrame:
    """Of (band, node, n, reach, comp, open) the rows that, by sizes and reaches, some set of another component in their
    bucket may meet where one of both is open. A bucket's sets are told by classes of nearly equal size."""
    size_class = F.floor(F.log("n") / math.log(1.01)).alias("size_class")
    told = [F.min("n").alias("n"), F.max("reach").alias("reach"), F.min("comp").alias("one"), F.max("comp").alias("other")]
    classes = there.groupBy("band", "open", size_class).agg(*told)
    sides = classes.groupBy("band").agg(F.collect_list(F.struct("open", "n", "reach", "one", "other")).alias("sides"))  # some hundred at most

    def met(e):
        other = (e["one"] != F.col("comp")) | (e["other"] != F.col("comp"))
        return (e["open"] | F.col("open")) & other & (e["n"] <= F.col("reach")) & (F.col("n") <= e["reach"])

    return salted_join(there, sides, "band", "node").where(F.exists("sides", met)).select(*there.columns)


def frequent_shingles(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (h, df) the most frequent shingles, ``most`` at most, by h; and the place of each in their order by df and h. All
    others are less frequent."""
    grade = F.floor(F.log2("df") * 8).cast("int")
    least, room = None, most
    for g, n in sorted(counts.groupBy(grade.alias("grade")).count().collect(), reverse=True):  # some hundred at most
        room -= n
        if room < 0:
            break
        least = g
    held = counts.where(F.lit(False) if least is None else grade >= least).select("h", "df").toArrow()
    h, df = (held.column(k).to_numpy() for k in ("h", "df"))
    place = np.empty(len(h), np.int32)
    place[np.lexsort((h, df))] = np.arange(len(h), dtype=np.int32)
    by_h = np.argsort(h)
    return h[by_h], place[by_h]


def prefixes(sets: DataFrame, listed: tuple[np.ndarray, np.ndarray], least: float) -> DataFrame:
    """(node, n, comp, open, h, reach): the shingles of each set up to the last place of any use, in the order of all
    shingles: those not ``listed`` by h, then the listed ones by frequency."""
    frequent, places = listed

    def run(batches):
        for batch in batches:
            taken, found, reaches = [], [], []
            for x in batch.column(4):
                h = np.frombuffer(x.as_buffer(), np.int64)
                reach = np.floor((len(h) - np.arange(len(h))) * ((1 + least) / least) - len(h) + 1e-6).astype(np.int64)  # as in _reach
                reach = reach[reach >= len(h) * least - 1e-6]
                place = np.full(len(h), -1, np.int32)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    place = np.where(frequent[at] == h, places[at], place)
                taken.append(len(reach))
                found.append(h[np.lexsort((h, place))[: len(reach)]])
                reaches.append(reach)
            at = pa.array(np.repeat(np.arange(batch.num_rows), taken).astype(np.int64))
            h, reach = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (found, reaches))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(4)), pa.array(h), pa.array(reach)], ["node", "n", "comp", "open", "h", "reach"])

    return sets.select("node", "n", "comp", "open", "shingles").mapInArrow(run, "node long, n long, comp long, open boolean, h long, reach long")


def rare_pairs(sets: DataFrame, large: DataFrame, comps: DataFrame, wanted: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Distinct pairs (a < b) of ``sets`` (node, n, shingles) in different components, one of them wanted, that may overlap
    by ``least``; ``large``: (band, node) of the large buckets.

    Shingles are put in one order, the rarest first. A pair that overlaps enough has a first shingle in common,
    and all it shares comes from there on in both: at place i a set of n shingles can only reach sets of
    up to (n - i) (1 + least) / least - n shingles. Shingles of two sets name a pair each, and the number of those of
    one or two sets alone rules out most sets, those that no set of another component in one of their buckets can reach.
    The others meet by their shingles up to the last place of any use, a fifth of them at 0.8; only these become rows.
    Any one order finds all pairs, so that of the shingles the frequent ones alone need a place by frequency.
    """

    def spread(batches):
        for batch in batches:
            held = batch.column(1).to_pylist()
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) // 8 for x in held]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.frombuffer(b"".join(held), np.int64))], ["node", "h"])

    ends = [F.min("node").alias("node"), F.max("node").alias("other")]
    rows = sets.select("node", "shingles").mapInArrow(spread, "node long, h long")
    counts = work_table(rows.groupBy("h").agg(F.count(F.lit(1)).alias("df"), *ends), "counts")
    twos = counts.where("df = 2").select("node", "other")
    own = counts.where("df <= 2").select("node").unionAll(twos.select("other")).groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    known = sets.select("node", "n").join(own, "node", "left").join(comps, "node", "left").join(wanted.withColumn("open", F.lit(True)), "node", "left")
    known = known.select("node", "n", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("comp", "node").alias("comp"), F.coalesce("open", F.lit(False)).alias("open"))
    known = work_table(known.withColumn("reach", _reach("n", "own", least)).drop("own"), "known")
    # Here and below a node meets what is known of it as one row, before its bands or shingles are told apart.
    held = large.groupBy("node").agg(F.collect_list("band").alias("bands"))  # K / BAND_ROWS at most
    there = held.join(known.where(F.col("reach") >= F.col("n") * least - 1e-6), "node")
    there = there.select(F.explode("bands").alias("band"), "node", "n", "comp", "open", "reach")
    for _ in range(PRUNINGS):
        there = work_table(_able(there), "able")
    able = there.select("node").distinct()
    chosen = sets.select("node", "shingles").join(known.join(able, "node", "left_semi"), "node")
    lead = work_table(prefixes(chosen, frequent_shingles(counts.where("df > 2"), LISTED), least), "prefixes")
    # Of each shingle: who can be met there at all.
    told = [F.min("comp").alias("one"), F.max("comp").alias("other"), F.count_if("open").alias("opens"), F.min("n").alias("low"), F.max("reach").alias("high")]
    met = lead.groupBy("h").agg(*told).where("one != other and opens > 0").drop("opens", "one", "other")
    lead = salted_join(lead, met, "h", "node").where("reach >= low and n <= high").drop("low", "high")
    a, b = lead.where("open").alias("a"), lead.alias("b")
    near = (F.col("a.comp") != F.col("b.comp")) & (F.col("a.n") <= F.col("b.reach")) & (F.col("b.n") <= F.col("a.reach"))
    pairs = a.join(b, (F.col("a.h") == F.col("b.h")) & near).select("a.node", F.col("b.node").alias("other"))
    of_a = known.select("node", "comp", "open")
    of_b = of_a.withColumnsRenamed({"node": "other", "comp": "o_comp", "open": "o_open"})
    twos = twos.distinct().join(of_a, "node").join(of_b, "other").where("comp != o_comp and (open or o_open)")
    pairs = pairs.unionByName(twos.select("node", "other"))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def node_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles): sorted shingle hashes, 8 bytes each."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, limit=SLICE_BYTES):
                row, h, _ = shingles(part.column(1))
                node, size = _node(row, h, part.num_rows)
                raw, ends = h.tobytes(), np.cumsum(size) * 8
                sets = pa.array([raw[e - 8 * s : e] for e, s in zip(ends, size, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(node), sets], ["node", "shingles"])
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def links(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose shingle sets overlap by ``least`` or more of their union."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            near = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            del batch
            yield near
        release_memory()

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes with a link: comp is the smallest node reached. Labels pass along links and
    then jump to the label's label, so a path of n nodes takes about log n rounds."""
    both = work_table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = work_table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        # The centre of a star is at many links' ends, and a large component is many nodes' label.
        met = salted_join(both, labels.withColumnRenamed("node", "b"), "b", "a")
        near = met.groupBy("a").agg(F.min("comp").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        above = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        jumped = salted_join(stepped, above, "comp", "node", "left").select("node", "was", F.least("comp", F.coalesce("above", "comp")).alias("comp"))
        new = work_table(jumped, "labels")
        labels = new.select("node", "comp")
        if new.where("was != comp").isEmpty():
            return labels


def find_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, weighting: str = "set") -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept.

    Documents are linked when their sets of five-word shingles overlap by ``least`` of their union or
    more (words are kept as they are; a text under five words is one shingle). A class is a connected
    component; class_id is its smallest id, and that document is kept. Null and blank texts have
    no shingles and are classes of one. A null id comes after others; a class with null ids only has a
    null class_id. Of rows repeated with one id and text one is kept. An empty table gives an
    empty result; other columns are ignored. ``weighting`` "count" lets signatures weigh a shingle by
    its times in the text; links are those of the sets in any case.
    """
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    rows = work_table(sketch(docs, weighting), "sketches").withColumn("salt", F.pmod(F.xxhash64("doc_id", "n"), F.lit(SALTS)).cast("int"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    local = rows.where("n > 0").groupBy("node", "n", "salt").agg(F.min(F.struct(order.alias("o"), "bands")).alias("best"), F.count(F.lit(1)).alias("times"))
    nodes = local.groupBy("node", "n").agg(F.min("best").alias("best"), F.sum("times").alias("times"), F.collect_set("salt").alias("used"))
    nodes = work_table(nodes.select("node", "n", F.col("best.o").alias("o"), F.col("best.bands").alias("bands"), "times", "used"), "nodes")
    live = work_table(live_bands(nodes.select("node", "n", "bands")), "bands")
    centre = work_table(centres(live.where(F.col("m") > PAIR_BUCKET)), "centres")
    pairs = work_table(candidate_pairs(live, centre, least), "pairs")
    crowd = live.where(F.col("m") > PAIR_BUCKET).select("node")
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowd).distinct()
    ids = nodes.join(involved, "node", "left_semi").select(F.col("o.doc_id").alias("key")).distinct()
    sets = work_table(node_sets(docs.join(ids, F.col("doc_id").eqNullSafe(F.col("key")), "left_semi")), "sets")
    edges = work_table(links(pairs, sets, least), "edges")
    comps = components(edges)
    wanted = work_table(open_nodes(live, centre, comps), "open")
    if not wanted.isEmpty():
        large = live.where(F.col("m") > PAIR_BUCKET).select("band", "node")
        crowd_sets = sets.join(crowd.distinct(), "node", "left_semi").join(nodes.select("node", "n"), "node")
        more = rare_pairs(crowd_sets, large, comps, wanted, least).join(pairs, ["a", "b"], "left_anti")
        more = work_table(more, "pairs")
        comps = components(edges.unionByName(links(more, sets, least)))
    told = nodes.select("node", "o", "times", "used").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = F.min(F.struct("o", "node"))
    classes = told.groupBy("comp").agg(first.alias("first"), F.sum("times").alias("class_size"))
    back = salted_join(told.select("node", "comp", F.explode("used").alias("salt")), classes, "comp", "node")
    back = back.select("node", "salt", F.col("first.o.doc_id").alias("class_id"), F.col("first.node").alias("first_node"), "class_size")
    found = rows.where("n > 0").select("doc_id", "node", "salt").join(back, ["node", "salt"])
    nth = F.row_number().over(Window.partitionBy("node", "salt", "doc_id").orderBy(F.lit(1)))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("first_node")) & (nth == 1)
    found = found.select("doc_id", "class_id", F.col("class_size").cast("long").alias("class_size"), kept.alias("kept"), "node")
    alone = rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "node")
    return found.unionByName(alone)


def keep_one_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The input's rows without those that find_near_duplicates doesn't keep, with the input's columns, whatever their names. Null and
    blank texts stay, of rows that repeat an id as many go as are not kept, and an empty table stays empty."""
    found = find_near_duplicates(df, id_col, text_col, least)
    gone = found.where("not kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__gone"))
    kept = found.where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[id_col].cast("long").alias("__id"))
    out = rows.join(kept, F.col("__id").eqNullSafe(F.col("__kept_id")), "left_semi")
    if gone.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi").isEmpty():
        return out.select("row.*")
    # Some id has rows that stay and rows that go: tell them apart by their shingle sets. Texts without shingles all stay.

    def nodes(texts: pd.Series) -> pd.DataFrame:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        parts = [_node(*shingles(part.column(0))[:2], part.num_rows) for part in chunks(batch, limit=SLICE_BYTES)]
        return pd.DataFrame({k: np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, np.int64) for i, k in enumerate(("node", "n"))})

    stay = found.where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("node").alias("__kept_node")).distinct()
    out = out.withColumn("__text", F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit("")))
    out = out.withColumn("__set", F.pandas_udf(nodes, "node long, n long")("__text"))
    out = out.join(stay, F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__set.node") == F.col("__kept_node")), "left_semi")
    one = F.row_number().over(Window.partitionBy("__id", "__set.node").orderBy(F.xxhash64("__text")))
    return out.withColumn("__one", one).where("__one = 1 or __set.n = 0").select("row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``. Nulls, ties, repeated rows, empty tables: see find_near_duplicates."""
    return find_near_duplicates(read_table(spark, sf_dir, "documents")).drop("node")
