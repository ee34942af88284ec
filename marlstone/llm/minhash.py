"""Near-duplicate documents: circulant MinHash signatures, banding, exact Jaccard confirmation, connected components.

1. One pass over the texts makes, per document, the hash of its shingle set, a signature and its band keys. Documents with the same
   set are one class from here on.
2. In each bucket (band key) every class is a candidate of one centre only, the class with the most company in its buckets: as many candidates
   as rows. They are confirmed on the full sets of both texts; only candidates' texts are moved.
3. Components of the links so far. Buckets that still hold several components go through an exact remainder: their classes
   are dealt into blocks, and each pair of blocks is compared inside a task, first on signatures alone; classes of the bucket's largest component are not compared with each
   other. Only classes that may have a link left get their full sets, and are compared on those. A task returns a spanning
   forest of the links it finds, never more rows than it has classes. So no link between components is lost to the choice of a centre.

With 32 bands of 4 coordinates a pair at similarity s meets in no band with probability (1 - s**4)**32: 6e-11 at 0.85, 5e-8 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import discard, give_back, kept_for, sized, stage, text_batches, without
from .graph import components

COORDINATES = 128
ROWS = 4
#: Classes, and shingles, of a block of the remainder, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Hubs with many members are spread over this many tasks.
SALTS = 32
#: Standard deviations that a signature's estimate may lie below the threshold before a pair of the remainder is given up.
SLACK = 6.5


def _profile(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("minhash")
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                sets = [np.unique(x) for x in sh.shingles(part.column(2).to_pylist(), n)]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = sh.signatures([sets[i] for i in full], COORDINATES) if full else np.empty((0, COORDINATES), np.uint32)
                keys = sh.bands(sig, ROWS)
                low = (sig & np.uint32(255)).astype(np.uint8)
                cls, band, tiny = ([None] * len(sets) for _ in range(3))
                for row, i in enumerate(full):
                    cls[i], band[i], tiny[i] = set_hash(sets[i]), keys[row], low[row].tobytes()
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(tiny, pa.binary())],
                    ["id", "check", "n_shingles", "cls", "bands", "low"],
                )
        give_back()

    return run


def set_hash(unique: np.ndarray) -> int:
    """64 bits for a set of hashes, given sorted."""
    total = sh.mix(unique ^ np.uint64(0x2545F4914F6CDD1D)).sum(keepdims=True) + np.array([len(unique)], np.uint64)
    return int(sh.mix(total).view(np.int64)[0])


def _confirm(n: int, num: int, den: int):
    """Rows sorted by (hub, salt, member): the hub's text comes first, then its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("minhash")
        hub, hub_set = None, None
        for batch in batches:
            a, cls, member = (batch.column(i).to_pylist() for i in (0, 1, 2))
            hits = []
            for at in range(0, len(batch), 256):
                texts = batch.column(3).slice(at, 256).to_pylist()
                for i, raw in enumerate(sh.shingles(texts, n), at):
                    own = np.unique(raw)
                    if set_hash(own) != cls[i]:  # another text under the same id
                        continue
                    if not member[i]:
                        hub, hub_set = a[i], own
                    elif hub == a[i]:
                        inter = len(np.intersect1d(hub_set, own, assume_unique=True))
                        if den * inter >= num * (len(hub_set) + len(own) - inter):
                            hits.append((a[i], cls[i]))
            yield pa.record_batch([pa.array([x[j] for x in hits], pa.int64()) for j in (0, 1)], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``pairs`` (a, a_id, b, b_id) whose full sets reach the threshold. A hub's text is sent once a salt, not once a member."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    rows = pairs.select("a", F.col("b").alias("cls"), F.col("b_id").alias("id"), F.lit(True).alias("member"), "salt").union(
        pairs.select("a", F.col("a").alias("cls"), F.col("a_id").alias("id"), F.lit(False).alias("member"), "salt").distinct()
    )
    rows = stage(rows, "candidates")
    with_text = texts.select("id", "text").join(sized(rows), "id").select("a", "cls", "member", "text", "salt")
    found = with_text.repartition("a", "salt").sortWithinPartitions("a", "salt", "member").mapInArrow(_confirm(n, num, den), "a long, b long")
    with text_batches(texts.sparkSession):
        found = stage(found, "links")
    discard(rows)
    return found


def _sets(n: int):
    """(cls, id, text) -> (cls, set): the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("minhash")
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                own = [np.unique(x) for x in sh.shingles(part.column(1).to_pylist(), n)]
                cls = part.column(0).to_pylist()
                keep = [i for i, s in enumerate(own) if set_hash(s) == cls[i]]
                yield pa.record_batch([pa.array([cls[i] for i in keep], pa.int64()), pa.array([own[i].tobytes() for i in keep], pa.binary())], ["cls", "set"])

    return run


def _hopeful(g: dict[str, np.ndarray], least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of two blocks of a bucket that may link, by lengths and signatures, and aren't in one component yet."""
    cut = COORDINATES * least - SLACK * np.sqrt(COORDINATES * least * (1 - least))
    band, blk, n, low = int(g["band"][0]), g["blk"], g["n"], g["low"]
    left = np.flatnonzero(blk == g["i"][0])
    right = left if g["i"][0] == g["j"][0] else np.flatnonzero(blk == g["j"][0])
    for at, x in enumerate(left):
        y = right[at + 1 :] if left is right else right
        y = y[(np.minimum(n[y], n[x]) >= least * np.maximum(n[y], n[x]) * (1 - 1e-12)) & (g["comp"][y] != g["comp"][x])]
        y = y[(low[y] == low[x]).sum(1) >= cut]
        if band and len(y):  # a pair belongs to the first band in which it meets
            y = y[~(g["bands"][y, :band] == g["bands"][x, :band]).any(1)]
        if len(y):
            yield int(x), y


def _screen(g: dict[str, np.ndarray], least: float) -> np.ndarray:
    """Which rows of two blocks may have a link left."""
    some = np.zeros(len(g["cls"]), bool)
    for x, y in _hopeful(g, least):
        some[x] = some[y] = True
    return np.flatnonzero(some)


def _forest(g: dict[str, np.ndarray], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links between different components of two blocks of a bucket that join anything not joined yet."""
    n, root = g["n"], {int(c): int(c) for c in g["comp"]}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum([len(s) for s in sets])
    code = [codes[e - len(s) : e] for e, s in zip(ends, sets, strict=True)]
    mark = np.zeros(int(codes.max()) + 1, bool)
    out = []
    for x, y in _hopeful(g, num / den):
        y = y[[find(int(c)) != find(int(g["comp"][x])) for c in g["comp"][y]]]
        if not len(y):
            continue
        mark[code[x]] = True
        inter = np.add.reduceat(mark[np.concatenate([code[k] for k in y])], np.cumsum([0, *[len(code[k]) for k in y[:-1]]]), dtype=np.int64)
        mark[code[x]] = False
        for k in y[den * inter >= num * (n[x] + n[y] - inter)]:
            a, b = find(int(g["comp"][x])), find(int(g["comp"][k]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(g["cls"][x]), int(g["cls"][k])))
    return out


_TASK = ("key", "i", "j", "cls", "n", "comp", "blk", "band")
_TASK_SCHEMA = "key long, i int, j int, band int, cls long, id long, n long, comp long, blk int, low binary, bands array<long>"


def _by_task(solve):
    """Rows sorted by (key, i, j): ``solve`` gets the rows of each two blocks of a bucket as a table, and as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("minhash")
        held: list[pa.RecordBatch] = []

        def solved(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            t = pa.Table.from_batches(held)
            held = []
            col = {k: t.column(k).to_numpy() for k in _TASK}
            cuts = np.flatnonzero((np.diff(col["key"]) != 0) | (np.diff(col["i"]) != 0) | (np.diff(col["j"]) != 0)) + 1
            edges = [0, *cuts.tolist(), len(t)]
            if not last:
                held = t.slice(edges[-2]).combine_chunks().to_batches()
                edges.pop()
            for p, q in zip(edges, edges[1:], strict=False):
                own = t.slice(p, q - p).combine_chunks()
                g = {k: v[p:q] for k, v in col.items()}
                g["low"] = np.frombuffer(b"".join(own.column("low").to_pylist()), np.uint8).reshape(-1, COORDINATES)
                g["bands"] = own.column("bands").chunk(0).flatten().to_numpy().reshape(-1, COORDINATES // ROWS)
                yield from solve(own, g)

        for batch in batches:
            for at in range(0, len(batch), 1000):
                held.append(batch.slice(at, 1000))
                if sum(map(len, held)) >= 4 * BLOCK:
                    yield from solved(False)
        yield from solved(True)

    return run


def _screened(least: float):
    def solve(own: pa.Table, g: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(keep := _screen(g, least)):
            yield from own.take(pa.array(keep)).combine_chunks().to_batches()

    return _by_task(solve)


def _linked(num: int, den: int):
    def solve(own: pa.Table, g: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = _forest(g, [np.frombuffer(x, np.uint64) for x in own.column("set").to_pylist()], num, den)
        if found:
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _by_task(solve)


def _remainder(members: DataFrame, classes: DataFrame, part: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b), between classes of one bucket that ``part`` leaves in different components, that join all such classes which the threshold links."""
    labelled = members.where("size > 2").join(part, F.col("cls") == F.col("node"), "left").select("key", "band", "cls", "n", F.coalesce("component", "cls").alias("comp"))
    held = labelled.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    whole = held.groupBy("key").agg(F.max(F.struct("m", "comp", "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda m, s: F.ceil(F.greatest(m / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    mixed = whole.select("key", F.col("top.comp").alias("top"), blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("others"), blocks(F.col("top.m"), F.col("top.s")).alias("tops"))
    place = lambda first, number: first + F.pmod(F.xxhash64("cls"), number).cast("int")
    dealt = labelled.join(mixed, "key").withColumn("blk", F.when(F.col("comp") == F.col("top"), place(F.col("others"), F.col("tops"))).otherwise(place(F.lit(0), F.col("others"))))
    last = F.when(F.col("comp") == F.col("top"), F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1  # the largest component meets the others only
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last))).withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other"))
    signed = dealt.select("key", "i", "j", "band", "cls", "comp", "blk").join(classes.select("cls", "id", "n", "low", "bands"), "cls")
    tasks = signed.select("key", "i", "j", "band", "cls", "id", "n", "comp", "blk", "low", "bands").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    hopeful = stage(tasks.mapInArrow(_screened(num / den), _TASK_SCHEMA), "hopeful")
    need = stage(hopeful.select("cls", "id").distinct(), "need")
    sets = texts.select("id", "text").join(sized(need), "id").select("cls", "text").mapInArrow(_sets(words), "cls long, set binary")
    full = hopeful.join(sets, "cls").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    with text_batches(texts.sparkSession):
        rest = stage(full.mapInArrow(_linked(num, den), "a long, b long"), "remainder")
    discard(hopeful, need)
    return rest


def _components(texts: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Staged rows (id, check, n_shingles, cls) of ``texts`` (id, check, text), and the component of each class (cls, comp). Rows with a null id link with nothing."""
    with text_batches(texts.sparkSession):
        rows = stage(texts.select("id", "check", "text").mapInArrow(_profile(words), "id long, check long, n_shingles long, cls long, bands array<long>, low binary"), "profiles")
    texts = texts.where("text is not null and id is not null")
    classes = stage(
        rows.where("cls is not null and id is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("low").alias("low")),
        "classes",
    )
    buckets = classes.select("cls", "n", F.posexplode("bands").alias("band", "key"))
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(buckets.join(sizes, "key"), "members")
    company = members.groupBy("cls").agg(F.sum("size").alias("company"))
    centres = members.join(company, "cls").groupBy("key").agg(F.max(F.struct("company", "cls", "n")).alias("hub"))
    stars = (
        members.join(centres, "key")
        .where("cls != hub.cls").where(den * F.least("n", "hub.n") >= num * F.greatest("n", "hub.n"))
        .select(F.col("hub.cls").alias("a"), F.col("cls").alias("b"))
        .distinct()
    )
    names = classes.select("cls", "id")
    stars = stars.join(names.toDF("a", "a_id"), "a").join(names.toDF("b", "b_id"), "b")
    links = _confirmed(stars, texts, words, num, den)
    part = components(links)
    rest = _remainder(members, classes, part, texts, words, num, den)
    if not rest.isEmpty():
        part = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest))
    labels = stage(classes.select("cls").join(part, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("component", "cls").alias("comp")), "labels")
    discard(classes, members, links, rest, part)
    return rows, labels


def near_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), kept.

    Documents link when ``den * |intersection| >= num * |union|`` of their sets of distinct ``words``-word shingles (A-Z lower-cased, words
    ``[^\\x20\\x09-\\x0D]+``). A text with fewer words has its whole sequence as one shingle. Null, empty and blank texts have no
    shingle and link with nothing. A null doc_id stands alone: component_id null, kept. Rows that repeat an id and a text are one
    document; rows that repeat an id with other texts join the components of these texts, which share that id. Whole texts of any length
    are read. Extra columns are ignored whatever their names; an empty table gives no rows. Sets are compared by 64-bit hashes of shingles.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("check"), F.col(text_col).alias("text"))
    rows, labels = _components(texts, words, num, den)
    named = rows.where("id is not null").join(labels, "cls").groupBy("comp").agg(F.min("id").alias("component"))
    verdicts = labels.join(named, "comp").select("cls", "component")
    linked = rows.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("cls")).alias("cls")).join(verdicts, "cls", "left")
    out = stage(linked.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id")), "near-groups")
    discard(rows, labels)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Rows without an id get one from here on, by their text, where they must be told apart.
NAMELESS = 1 << 62


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns: of documents that links join, as in :func:`near_groups`, the row with the smallest id stays, null ids last.

    Unlike there, rows with a null id take part. Of several texts with that id the one with the smallest hash stays, and of rows that repeat both the
    one whose columns come first as JSON. Texts without shingles all stay. Columns of any name are kept as they are; an empty table stays empty.
    """
    check = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    doc_id = F.coalesce(docs[id_col].try_cast("long"), F.lit(NAMELESS) + F.shiftright(F.abs(check), 2))
    rows, labels = _components(docs.select(doc_id.alias("id"), check.alias("check"), docs[text_col].alias("text")), words, num, den)
    own = rows.where("cls is not null").select("id", "check", "cls").join(labels, "cls").select("id", "check", "comp")
    first = own.groupBy("comp").agg(F.min(F.struct("id", "check")).alias("first"), F.count("*").alias("n")).where("n > 1")
    keys = own.join(first, "comp").groupBy(F.col("id").alias("doc_id"), "check", (F.struct("id", "check") == F.col("first")).alias("kept")).agg(F.count("*").alias("m"))
    keys = stage(keys, "groups")
    lost, repeated = stage(keys.where("not kept").select("doc_id", "check"), "lost"), stage(keys.where("kept and m > 1").select("doc_id", "check"), "repeated")
    discard(rows, labels, keys)
    return without(docs, doc_id, check, lost, repeated)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
c AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), chr(10))) AS h, sh FROM s),
u AS (SELECT h, min(doc_id) AS id, any_value(n) AS n, any_value(sh) AS sh FROM c WHERE n > 0 GROUP BY h),
e AS (SELECT id, n, unnest(sh) AS x FROM u),
f AS (SELECT id, n, x FROM (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM e) WHERE df > 1),
p AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT c.doc_id, c.n AS n_shingles, coalesce(m.root, u.id, c.doc_id) AS component_id, c.doc_id = coalesce(m.root, u.id, c.doc_id) AS kept
FROM c LEFT JOIN u ON c.h = u.h AND c.n > 0 LEFT JOIN m ON m.id = u.id
"""
