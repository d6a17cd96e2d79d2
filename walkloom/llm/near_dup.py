"""MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes the set of its distinct shingles; texts with equal sets form a class, kept once (copies are
   links by definition and never meet in a bucket).
2. Signatures of `perms` MinHash values are cut into bands of `rows`; classes that share a band value are
   candidates. A bucket of up to `small` members compares them all; a larger one never emits all its pairs. First,
   its pivot, the member whose buckets are fullest (the centre of a group of copies), is compared with the rest.
   Pairs inside one component can change nothing, so a bucket whose members are one component is done. In the
   others, members x and y of different components are compared only if they can still be linked, given what they
   share with the pivot c: what c loses to x or y, as bits, bounds what they share inside c. Either that alone
   suffices, which bounds |y| from above, or x and y share enough outside c, and then meet in the prefixes of x - c
   and y - c in one order, common shingles last (prefix filter; a sample tells what is common, any order is exact).
   Every other pair is provably below the threshold. Beside a pivot that very many short texts almost reach, this
   is still a join of each with those of nearly its size.
3. A pair's signatures are compared `batch` values at a time; it is dropped once the posterior probability (uniform
   prior, binomial matches) that its similarity reaches the threshold is below `miss`.
4. Survivors are confirmed on full shingle sets: 100 * |A n B| >= 100 * threshold * |A u B| in integers. A class's
   set is cut again from one of its texts, which must give the class's digest.
5. Components of the confirmed links give each document the smallest id reachable.

A pair at similarity s shares no band with probability (1 - s^rows)^bands, were the hashes independent: 2e-15 at 0.8
with 64 bands of 4. `miss` bounds what pruning may lose of each pair.

Defined cases: null, empty and blank texts have no shingles and link with nothing, not even each other; texts of any
length are read whole, a task holds the sets of one batch, at least one text's; classes are named by the digest of
their set, so ids may repeat, with the same text or another, or be null: each row has the component of its own text; a
component without any id is null; ids must be numbers or read as such; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkloom.llm.textkernels import MinHash, digest16, mix64, shingle_sets
from walkloom.operators.components import component_labels
from walkloom.sharedfs import materialize, release


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest of n matches with which P(similarity >= threshold) is still at least miss: with a uniform prior
    that probability after m matches is P(Binomial(n + 1, threshold) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _sketch(k: int, perms: int, rows: int, with_sets: bool = False):
    """Arrow batches (id, text) -> (id, n, digest, sig, bands)."""
    schema = pa.schema([("id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
    bands = perms // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mh = MinHash(perms)
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

        def flush(i, keys, s):
            out = mh.signatures([x if len(x) else np.zeros(1, np.uint64) for x in s])
            b = np.zeros((len(s), bands), np.uint64) + salt
            for j in range(rows):
                b = mix64(b * np.uint64(0x9E3779B97F4A7C15) + out[:, j::rows][:, :bands])
            some = np.array([len(x) > 0 for x in s], bool)
            flat = b[some].astype(np.int64, copy=False).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), pa.array(flat))
            return pa.record_batch([i, keys, pa.array([len(x) for x in s], pa.int64()), pa.array([digest16(x) if len(x) else None for x in s], pa.binary()), pa.array([r.tobytes() if len(x) else None for r, x in zip(out, s, strict=True)], pa.binary()), lists], schema=schema)

        for batch in batches:
            ids, keys, sets, at, held = batch.column(0), batch.column(2), [], 0, 0
            for r, s in shingle_sets(batch.column(1), k):
                sets.append(s)
                held += len(s)
                if held >= 1 << 19:
                    yield flush(ids.slice(at, len(sets)), keys.slice(at, len(sets)), sets)
                    sets, at, held = [], r + 1, 0
            if sets:
                yield flush(ids.slice(at, len(sets)), keys.slice(at, len(sets)), sets)

    return run, "id long, row_key long, n long, digest binary, sig binary, bands array<long>"


def _sets_of(k: int):
    """(cid, text) -> (cid, shingles) where the text's set has the digest cid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            ids, sets, held = [], [], 0
            for r, s in shingle_sets(batch.column(1), k):
                if digest16(s) == names[r]:
                    ids.append(names[r])
                    sets.append(s.tobytes())
                    held += len(s)
                if held >= 1 << 20 or r + 1 == batch.num_rows:
                    yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(sets, pa.binary())], names=["cid", "shingles"])
                    ids, sets, held = [], [], 0

    return run


def _beside(percent: int):
    """(pivot, cid, root, set of cid, set of pivot) -> what cid lacks of the pivot, as bits, and what lies outside it.
    reach: largest size of another text that could be linked through the pivot's shingles alone; prefix: how many
    shingles outside the pivot, in any order, must hold a shared one, if another text is to be linked through those; marks:
    1024 bits of the shingles outside, and spare: how many more these are than bits."""
    names = ["pivot", "cid", "root", "n", "pivot_n", "reach", "lacks", "prefix", "outside", "marks", "spare"]
    kinds = [pa.binary()] * 3 + [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for c, i, root, x, p in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                x, p = np.frombuffer(x, np.uint64), np.frombuffer(p, np.uint64)
                rest = np.setdiff1d(x, p, assume_unique=True)
                both = len(x) - len(rest)
                need = max(1, -(-percent * len(x) // 100) - both)
                bits = np.zeros(-(-len(p) // 64) * 64, bool)
                bits[: len(p)] = ~np.isin(p, x, assume_unique=True)
                marks = np.zeros(1024, bool)
                marks[(rest % np.uint64(1024)).astype(np.int64)] = True
                out.append((c, i, root, len(x), len(p), (100 + percent) * both // percent - len(x), np.packbits(bits).view(np.int64), max(0, len(rest) - need + 1), rest.view(np.int64), np.packbits(marks).view(np.int64), len(rest) - int(marks.sum())))
            cols = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.record_batch([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=names)

    return run


def _prune(perms: int, batch_size: int, threshold: float, miss: float):
    """(a, b, sig_a, sig_b) -> surviving (a, b)."""
    need = [(n, least_matches(n, threshold, miss)) for n in range(batch_size, perms + 1, batch_size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, perms) for c in (2, 3))
                alive, match, before = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64), 0
                for n, least in need:
                    match[alive] += (x[alive, before:n] == y[alive, before:n]).sum(1)
                    alive, before = alive[match[alive] >= least], n
                yield pa.record_batch([part.column(0).take(pa.array(alive)), part.column(1).take(pa.array(alive))], names=["a", "b"])

    return run


def _confirm(percent: int):
    """(a, b, set_a, set_b) -> (a, b, inter, total) of pairs that reach percent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, perms: int = 256, rows: int = 4, batch: int = 16, miss: float = 1e-6, small: int = 5) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, kept, class_id); class_id is the digest of the row's set.
    Ids must be numbers, or texts that are numbers."""
    run, kinds = _sketch(k, perms, rows)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    text = text.withColumn("row_key", F.xxhash64("id", F.coalesce("text", F.lit(""))))
    sketch = materialize(text.select("id", "text", "row_key").mapInArrow(run, kinds), "near-sketch")
    # A class is named by the digest of its set: ids may repeat with other texts, or be null.
    classes = sketch.filter("n > 0").groupBy(F.col("digest").alias("cid")).agg(F.min("id").alias("low"), F.min("row_key").alias("row_key"), F.min(F.struct("sig", "bands")).alias("s"))
    classes = materialize(classes.select("cid", "low", "row_key", "s.sig", "s.bands"), "near-classes")
    sigs = classes.select("cid", "sig")
    members = classes.select("cid", F.explode("bands").alias("bucket"))
    full = materialize(members.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "near-full")
    members = materialize(by_size(members, full, "bucket", "m"), "near-buckets")
    few = members.filter(F.col("m") <= small).groupBy("bucket").agg(F.sort_array(F.collect_list("cid")).alias("c"))
    each = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.lit(small)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    close = few.select(F.explode(each).alias("p")).select("p.a", "p.b")
    weight = members.groupBy("cid").agg(F.sum("m").alias("w"))
    members = materialize(members.filter(F.col("m") > small).join(weight, "cid").select("bucket", "cid", "m", "w"), "near-large")
    centre = materialize(members.groupBy("bucket").agg(F.max(F.struct("w", "cid"))["cid"].alias("pivot"), F.count("*").alias("m")), "near-pivots")
    pairs = by_size(members.select("bucket", "cid"), centre, "bucket", "pivot").filter("cid <> pivot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).unionByName(close).distinct()

    def sets_of(who: DataFrame) -> DataFrame:
        """(cid, shingles) of the classes in who(cid): their texts are found again by row key, cut again, and taken
        only if the set has the class's digest."""
        wanted = text.join(who.join(classes.select("cid", "row_key"), "cid"), "row_key").groupBy("row_key", "cid").agg(F.min("text").alias("text"))
        return materialize(wanted.select("cid", "text").mapInArrow(_sets_of(k), "cid binary, shingles binary"), "near-sets")

    def with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
        p = pairs.join(sets.select(F.col("cid").alias(b), F.col("shingles").alias("set_b")), b)
        return p.join(sets.select(F.col("cid").alias(a), F.col("shingles").alias("set_a")), a)

    def linked(pairs: DataFrame) -> DataFrame:
        p = pairs.join(sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b")
        p = p.join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a").select("a", "b", "sig_a", "sig_b")
        alive = materialize(p.mapInArrow(_prune(perms, batch, percent / 100, miss), "a binary, b binary"), "near-alive")
        sets = sets_of(alive.select("a").union(alive.select("b")).distinct().withColumnRenamed("a", "cid"))
        out = with_sets(alive, sets, "a", "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a binary, b binary")
        out = materialize(out, "near-links")
        release(alive, sets)
        return out

    links = linked(pairs)
    roots = component_labels(links)
    at = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", "w", F.coalesce("root", "cid").alias("root"))
    at = materialize(at, "near-at")
    open_ = at.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket")
    # From here on a bucket is seen from the centre of its pivot's component, which many buckets share.
    hub = at.groupBy("root").agg(F.max(F.struct("w", "cid"))["cid"].alias("hub"))
    lead = centre.join(open_, "bucket").join(roots.select(F.col("node").alias("pivot"), "root"), "pivot", "left")
    lead = lead.select("bucket", "m", F.coalesce("root", "pivot").alias("root")).join(hub, "root").select("bucket", "m", F.col("hub").alias("pivot"), F.col("root").alias("p_root"))
    lead = materialize(lead, "near-lead")
    # A pair not settled yet shares open buckets only (in any other it was compared, or is one component).
    at = materialize(by_size(at.drop("w"), lead, "bucket", "pivot", "p_root"), "near-open-at")
    lead = at.select("pivot", "p_root").distinct()
    open_ = materialize(at.select("pivot", "cid", "root").distinct(), "near-open")
    if open_.limit(1).count():
        sets = sets_of(open_.select("cid").union(open_.select("pivot")).distinct())
        beside = with_sets(open_, sets, "pivot", "cid").select("pivot", "cid", "root", "set_b", "set_a")
        beside = materialize(beside.mapInArrow(_beside(percent), "pivot binary, cid binary, root binary, n long, pivot_n long, reach long, lacks array<long>, prefix long, outside array<long>, marks array<long>, spare long"), "near-beside")
        # Through the pivot alone: sizes meet in steps of a tenth. Members linked with the pivot are one component; the
        # side without that link is spread over the steps.
        step = lambda c: F.floor(F.log(c.cast("double")) / F.log(F.lit(1.1)))
        small_side = F.ceil(F.col("n") * percent / 100)
        apart = beside.join(lead, "pivot").filter((F.col("root") != F.col("p_root")) & (F.col("reach") >= small_side))
        near = apart.select("pivot", "cid", "root", "n", "pivot_n", "reach", "lacks", F.explode(F.sequence(step(small_side), step(F.col("reach")))).alias("step"))
        other = beside.select("pivot", F.col("cid").alias("o_cid"), F.col("root").alias("o_root"), F.col("n").alias("o_n"), F.col("reach").alias("o_reach"), F.col("lacks").alias("o_lacks"), step(F.col("n")).alias("step"))
        lost = F.aggregate(F.zip_with("lacks", "o_lacks", lambda x, y: F.bit_count(x.bitwiseOR(y)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
        both, size = F.col("pivot_n") - lost, F.col("n") + F.col("o_n")
        inside = (both * (100 + percent) >= size * percent) & F.expr("root <> o_root and o_n <= reach and n <= o_reach")
        near = near.join(other, ["pivot", "step"]).filter(inside).select(F.least("cid", "o_cid").alias("a"), F.greatest("cid", "o_cid").alias("b"))
        # Outside the pivot: shared shingles among the rarest of each.
        each = materialize(prefixes(beside).select("pivot", "cid", "root", F.explode("head").alias("shingle")), "near-heads")
        seen = each.groupBy("pivot", "shingle").agg(F.count("*").alias("df")).filter("df > 1")
        head = each.join(seen, ["pivot", "shingle"]).select("pivot", "shingle", "cid", "root")
        # What a pair can share at most, bits of very long pivots left aside, settles most of those that meet.
        spare = beside.select("pivot", "cid", "n", "pivot_n", "marks", "spare", F.when(F.size("lacks") <= 64, F.col("lacks")).alias("lacks"))
        head = materialize(head.join(spare, ["pivot", "cid"]), "near-prefix")
        other = head.select("pivot", "shingle", *[F.col(c).alias(f"o_{c}") for c in ("cid", "root", "n", "marks", "spare", "lacks")])
        alike = F.aggregate(F.zip_with("marks", "o_marks", lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
        # Of two shared shingles with one mark, one is spare on either side.
        can = F.coalesce((both + alike + F.least("spare", "o_spare")) * (100 + percent) >= size * percent, F.lit(True))
        far = head.join(other, ["pivot", "shingle"]).filter(F.expr("cid < o_cid and root <> o_root") & can).select(F.col("cid").alias("a"), F.col("o_cid").alias("b"))
        more = linked(near.unionByName(far).distinct())
        if more.limit(1).count():
            roots = component_labels(links.unionByName(more))
    comp = classes.select(F.col("cid").alias("digest"), "low").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    comp = materialize(comp, "near-roots")
    named = materialize(comp.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("m")), "near-names")
    comp = materialize(by_size(comp.select("digest", "root"), named, "root", "component_id"), "near-components")
    return _attach(sketch, comp)


def prefixes(beside: DataFrame, sample: int = 32) -> DataFrame:
    """beside(pivot, cid, root, prefix, outside ascending) -> (pivot, cid, root, head): the first `prefix` shingles of
    outside in an order that all members of a pivot share: those common there last. Two members with as many shared
    shingles outside as prefix asks for share one of their heads in any such order, so a sample of about `sample`
    members decides what is common; it changes how many meet, not what is found. Where it has all members, shingles of
    one member, which meet nothing, are left out."""
    some = beside.filter("prefix > 0").select("pivot", "cid", "root", "prefix", "outside")
    size = materialize(some.groupBy("pivot").agg(F.count("*").alias("m")).filter("m > 1"), "near-sizes")
    some = materialize(by_size(some, size, "pivot", "m"), "near-outside")
    told = some.filter(F.pmod(F.xxhash64("cid"), F.col("m")) < sample).select("pivot", F.explode("outside").alias("shingle"))
    common = told.groupBy("pivot", "shingle").agg(F.count("*").alias("df")).filter("df > 1").groupBy("pivot").agg(F.collect_list("shingle").alias("common"))
    common = materialize(size.join(common, "pivot", "left").select("pivot", "m", F.coalesce("common", F.array().cast("array<long>")).alias("common")), "near-common")
    some = by_size(some, common, "pivot", "common", heavy=200)
    head = F.slice(F.concat(F.array_except("outside", "common"), F.array_intersect("outside", "common")), F.lit(1), F.col("prefix").cast("int"))
    return some.select("pivot", "cid", "root", F.when(F.col("m") <= sample, F.array_intersect(head, "common")).otherwise(head).alias("head"))


def by_size(rows: DataFrame, info: DataFrame, key: str, *values: str, heavy: int = 2000) -> DataFrame:
    """rows(key, ..) joined with info(key, m, values..), one row a key, m its number of rows. Rows of keys with more
    than a share of 1 / heavy of them, of which there are fewer than `heavy`, are told apart by literals and looked
    up by broadcast, so that no join key is hot and rows without a key in info meet no more than one join."""
    total = info.agg(F.sum("m")).first()[0] or 0
    often = F.col("m") > max(1, total // heavy)
    hot = [r[0] for r in info.filter(often).select(key).collect()]
    names = [c for c in rows.columns if c not in values]
    rows, info = rows.select(*names), info.select(key, "m", *[F.col(v).alias(f"i_{v}") for v in values])
    out = [*names, *[F.col(f"i_{v}").alias(v) for v in values]]
    if not hot:
        return rows.join(info.drop("m"), key).select(*out)
    is_hot = F.expr(f"`{key}` in ({', '.join(f'{k}L' if isinstance(k, int) else f"X'{bytes(k).hex()}'" for k in hot)})")
    near = rows.filter(is_hot).join(F.broadcast(info.filter(often).drop("m")), key)
    return near.select(*out).unionByName(rows.filter(~is_hot).join(info.filter(~often).drop("m"), key).select(*out))


def _attach(sketch: DataFrame, comp: DataFrame, heavy_share: float = 0.001) -> DataFrame:
    """Give each document its class's component. Classes with at least heavy_share of the rows (at most
    1 / heavy_share of them) come by broadcast, so that no join key is hot."""
    size = sketch.filter("n > 0").groupBy("digest").agg(F.count("*").alias("rows"))
    total = sketch.count()
    rows, heavy = sketch.select("id", "row_key", "n", "digest"), None
    if total * heavy_share >= 2:
        heavy = size.filter(F.col("rows") >= max(2, int(total * heavy_share))).join(comp, "digest")
        heavy = materialize(heavy.select(F.col("digest").alias("h_digest"), F.col("root").alias("h_root"), F.col("component_id").alias("h_comp")), "near-heavy")
        rows = rows.join(F.broadcast(heavy), F.col("digest") == F.col("h_digest"), "left")
    else:
        rows = rows.withColumns({"h_digest": F.lit(None).cast("binary"), "h_root": F.lit(None).cast("binary"), "h_comp": F.lit(None).cast("long")})
    # Rows of heavy classes and empty texts find nothing more: their keys are no digests.
    lone = F.col("h_digest").isNull() & F.col("digest").isNotNull()
    look = F.when(lone, F.col("digest")).otherwise(F.col("row_key").cast("string").cast("binary"))
    rows = rows.withColumn("look", look).join(comp.withColumnRenamed("digest", "look"), "look", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).when(F.col("h_digest").isNotNull(), F.col("h_comp")).otherwise(F.col("component_id"))
    return rows.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.col("digest").alias("class_id"), F.coalesce("h_root", "root").alias("group_id"), "row_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each component, that of the smallest id (null ids last, then the smallest hash of id and
    text); rows without words all stay."""
    found = near_duplicates(docs, id_col, text_col, **how).filter("group_id is not null")
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row_key"))
    stay = materialize(found.groupBy("group_id").agg(first.alias("f"), F.count("*").alias("n")).select("f.id", "f.row_key"), "near-stay")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.col(id_col).cast("long"), text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), key.alias("_key"), text.rlike(r"[^\x20\x09-\x0D]").alias("_words"))
    met = rows.join(stay, (F.col("_key") == F.col("row_key")) & F.col("_id").eqNullSafe(F.col("id")), "left_semi").filter("_words")
    if found.join(stay, (found["row_key"] == stay["row_key"]) & found["id"].eqNullSafe(stay["id"]), "left_semi").groupBy("id", "row_key").count().filter("count > 1").limit(1).count():
        met = met.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_key"))).filter("_n = 1")
    return met.select("_row.*").unionByName(rows.filter("not _words").select("_row.*"))
