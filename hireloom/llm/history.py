"""Checking new batches against everything accepted, with a segment index for edit distance (problem 4).

A title is written in one canonical way (level words apart, team behind the role, abbreviations spelled out), and two titles
of one company, location and level are the same when at most two edits (insertion, deletion, substitution, swap of neighbours)
part their canonical texts and the words that differ aren't both words of their own. Two edits touch at most four neighbouring
places, so of five segments of a text one is left whole; it stands in the other text, shifted by no more than the edits on its
left allow. The index stores the five segments of each accepted text by length and position; a batch probes it with the substrings
that can meet them, verifies what meets, and appends what it didn't hold yet.

The index is a set of folders, one for each append; a marker written last makes a folder count, so an append that was killed is
simply made again. Each folder is split by a hash of company and location (ids: of the id) into as many parts as its rows need. A
probe reads only the parts its batch falls into, and a bitmap of the batch's keys drops all other rows before anything is
shuffled; so its cost follows the batch, not the history. Folders are put together when they become many.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom.common import lookup, materialise, scratch_path
from hireloom.llm.linking import fold, within_two_edits
from hireloom.llm.sketching import bits_for, key_bitmap, passes, share

EDITS, SEGMENTS = 2, 5
#: Rows of one part of the index, about, and folders at which they are put together.
PART_ROWS, MOST_FOLDERS = 50_000, 12
#: A word is one of its own beside another if it stands in so many titles, and in so great a part of the other's number: a typo is
#: far rarer than what was meant, however large the history is.
OWN_LEAST, OWN_SHARE = 3, 1 / 20
#: Probe keys of a text, about; slots of the batch's bitmap for each key, and its least and greatest size (128 MB) in bits. Beyond it
#: more rows of the parts that are read pass on to the join; results stay the same.
KEYS, BITMAP_SLOTS, BITMAP_LEAST, BITMAP_MOST = 45, 8, 16, 30

# Level words, and short forms of words in titles.
LEVELS = frozenset("intern trainee graduate junior mid senior lead principal staff head chief i ii iii iv v vi".split())
SHORT = {
    "jr": "junior", "sr": "senior", "snr": "senior", "princ": "principal", "1": "i", "2": "ii", "3": "iii", "4": "iv", "5": "v", "6": "vi",
    "eng": "engineer", "engr": "engineer", "engg": "engineer", "mgr": "manager", "mngr": "manager", "dev": "developer", "admin": "administrator",
    "tech": "technician", "spec": "specialist", "assoc": "associate", "coord": "coordinator", "rep": "representative", "exec": "executive",
    "dir": "director", "asst": "assistant", "mach": "machine", "acct": "accountant", "sci": "scientist", "arch": "architect",
}
_NOISE = re.compile(
    r"\((?:[mfwdxih](?:/[mfwdxih*]+)+|all genders?|full[- ]time|part[- ]time|permanent|contract|remote|hybrid|on-?site)\)"
    r"|\[(?:remote|hybrid|on-?site|[^\]\w]*)\]|\|\s*(?:remote|hybrid|on-?site)\b|\s[-–—]\s*(?:remote|hybrid|on-?site|immediate start|\d+ (?:openings?|positions?|roles?))\s*(?=$|[\s(\[|#])"
    r"|\(?\b(?:req(?:uisition)?|job|ref)\.?\s*(?:id|no\.?|#)?\s*\d{3,}\)?|\(?\b[jr]r?-?\d{3,}\)?|\(?#\s*\d+\)?|\b(?:new|urgent|hot)!+"
)


def canonical(title: str | None, aliases: dict[str, str]) -> tuple[str, str] | None:
    """(levels, text) of a title; ``aliases`` spells out short forms of whole roles. None without a letter or digit."""
    text = fold(title or "")
    before = None
    while before != text:
        before, text = text, _NOISE.sub(" ", text)
    head, colon, tail = text.partition(":")
    if colon and tail.strip():  # "team: role"
        text = f"{tail} , {head}"
    words = re.findall(r"\w+", re.sub(r"\b(back|front)[\s-]+end\b", r"\1end", text).replace("+", "p").replace("'", ""))
    words = [SHORT.get(w, w) for w in words]
    words = ["technical" if w == "technician" and words[i + 1 : i + 2] == ["writer"] else w for i, w in enumerate(words)]
    levels = [w for w in words if w in LEVELS]
    rest = _spelled([w for w in words if w not in LEVELS], aliases)
    return (" ".join(sorted(set(levels))), rest) if rest or levels else None


def _spelled(words: list[str], aliases: dict[str, str]) -> str:
    """The words with short forms spelled out, the longest of each place first."""
    out, at = [], 0
    while at < len(words):
        for n in range(min(4, len(words) - at), 0, -1):
            if (whole := aliases.get(" ".join(words[at : at + n]))) is not None:
                out.append(whole)
                at += n
                break
        else:
            out.append(words[at])
            at += 1
    return " ".join(out)


def segments(n: int) -> list[tuple[int, int]]:
    """(start, end) of the segments of a text of n signs; the last ones are longer by one where n isn't a multiple."""
    short, longer = n // SEGMENTS, n % SEGMENTS
    out, at = [], 0
    for i in range(SEGMENTS):
        size = short + (i >= SEGMENTS - longer)
        out.append((at, at + size))
        at += size
    return out


def index_keys(text: str) -> list[str]:
    """Keys stored for a text: length, position and content of each segment; very short texts have one key."""
    if len(text) < 2 * SEGMENTS:
        return ["short"]
    return [f"{len(text)}:{i}:{text[a:b]}" for i, (a, b) in enumerate(segments(len(text)))]


def probe_keys(text: str) -> list[str]:
    """Keys that a text within EDITS of this one must have stored: an untouched segment is shifted by s where |s| + |d - s| <= EDITS, d being the difference of lengths."""
    n, out = len(text), set()
    if n < 2 * SEGMENTS + EDITS:
        out.add("short")
    for m in range(max(n - EDITS, 2 * SEGMENTS), n + EDITS + 1):
        d = n - m
        for i, (a, b) in enumerate(segments(m)):
            for s in range(-EDITS, EDITS + 1):
                if abs(s) + abs(d - s) <= EDITS and 0 <= a + s and b + s <= n:
                    out.add(f"{m}:{i}:{text[a + s : b + s]}")
    return sorted(out)


def differences(x: str, y: str) -> list[tuple[str, str]] | None:
    """Pairs of words that differ, "" where one has no counterpart; None where more than EDITS part the texts. No pair: the same title."""
    if x == y:
        return []
    if not within_two_edits(x, y):
        return None
    a, b = x.split(), y.split()
    if len(a) != len(b):
        return [] if "".join(a) == "".join(b) else [(w, "") for w in sorted({*a} ^ {*b})]
    return [(v, w) for v, w in zip(a, b) if v != w]


def same_title(x: str, y: str, known: frozenset[str]) -> bool:
    """Whether two titles are one, ``known`` being words of their own."""
    pairs = differences(x, y)
    return pairs is not None and not any(v in known and (not w or w in known) for v, w in pairs)


def own_words(n: int, other: int) -> bool:
    """Whether two words in so many titles each are both words of their own."""
    return min(n, other) >= max(OWN_LEAST, OWN_SHARE * max(n, other))


def standardise(rows: DataFrame, aliases: dict[str, str], *columns: str) -> DataFrame:
    """Adds ``block`` (company, location and levels) and ``text`` to (company, location, title, columns...); null where one of them is missing."""
    shared = share(rows, aliases)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[str, str] | None] = {}
        for batch in batches:
            company, location, title = (batch.column(i).to_pylist() for i in range(3))
            blocks, texts = [], []
            for c, p, t in zip(company, location, title):
                if t not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[t] = canonical(t, shared.value)
                found = seen[t]
                fine = found is not None and c is not None and p is not None
                blocks.append(f"{c}\x01{p}\x01{found[0]}" if fine else None)
                texts.append(found[1] if fine else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(blocks, pa.string()), pa.array(texts, pa.string())], names=[*columns, "block", "text"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return rows.select("company", "location", "title", *columns).mapInArrow(run, f"{schema}, block string, text string")


def _hashed(block: str, keys: list[str]) -> list[int]:
    start = xxhash.xxh64(block.encode("utf-8", "surrogatepass"))
    out = []
    for k in keys:
        h = start.copy()
        h.update(b"\x02" + k.encode("utf-8", "surrogatepass"))
        out.append(h.intdigest())
    return out


def _keyed(texts: DataFrame, keys) -> DataFrame:
    """(block, text, ...) -> the same once for each key, a hash of the block and what ``keys`` gives for the text."""
    fields = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hashed(b, keys(t)) for b, t in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist())]
            values = np.array([k for ks in found for k in ks], dtype=np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(ks) for ks in found]), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "keys"])

    return texts.mapInArrow(run, f"{fields}, keys array<bigint>").select(*texts.columns, F.explode("keys").alias("key"))


def _only(rows: DataFrame, slot: Column, bitmap) -> DataFrame:
    """Those rows whose slot is set in a shared bitmap."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bitmap.value, batch.column(len(names)).to_numpy()))).select(names)

    return rows.withColumn("_slot", slot).mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))


class SegmentIndex:
    """The accepted texts' segments, the words they have, and the ids, kept in the shared folder."""

    KINDS = {"texts": "block string, text string, at bigint, key bigint, bucket int", "ids": "id string, at bigint, bucket int", "words": "word string, n bigint, bucket int"}
    BY = {"texts": "block", "ids": "id", "words": "word"}

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "segment-index")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def folders(self) -> dict[str, dict[str, int]]:
        """The folders that count, each with the number of parts of each kind of table: those marked as done that no other replaces."""
        if not self._fs.exists(self._at(self.path)):
            return {}
        done, gone = {}, set()
        for status in self._fs.listStatus(self._at(self.path)):
            name = status.getPath().getName()
            if name.endswith(".done"):
                stream = self._fs.open(status.getPath())
                mark = json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
                stream.close()
                done[name[: -len(".done")]] = mark["parts"]
                gone |= set(mark["replaces"])
        return {k: v for k, v in sorted(done.items()) if k not in gone}

    def _write(self, tables: dict[str, tuple[DataFrame, int]], replaces: list[str]) -> None:
        """One folder of these tables, each with about how many rows it has."""
        folder, parts = uuid.uuid4().hex, {}
        for kind, (df, n) in tables.items():
            parts[kind] = max(1, -(-n // PART_ROWS))
            order = ["bucket", "key"] if kind == "texts" else ["bucket", self.BY[kind]]
            split = df.withColumn("bucket", self._bucket(kind, parts[kind])).repartition("bucket").sortWithinPartitions(*order)
            split.write.partitionBy("bucket").parquet(f"{self.path}/{folder}/{kind}")
        self._mark(folder, {"parts": parts, "replaces": replaces})

    def _mark(self, folder: str, mark: dict) -> None:
        """The folder counts from now on, and those it replaces no longer: one file, written whole under another name first."""
        made, final = self._at(f"{self.path}/{folder}.making"), self._at(f"{self.path}/{folder}.done")
        out = self._fs.create(made, True)
        out.write(bytearray(json.dumps(mark).encode()))
        out.close()
        self._fs.rename(made, final)

    def _bucket(self, kind: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(self.BY[kind]), F.lit(parts)).cast("int")

    def append(self, standard: DataFrame) -> None:
        """Adds (id, at, block, text); of equal texts and ids the earliest ``at`` is kept. Texts and ids that it held before may come
        again (check_batch leaves them out)."""
        texts = standard.where(F.col("text").isNotNull()).groupBy("block", "text").agg(F.min("at").alias("at"))
        ids = standard.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("at").alias("at"))
        self._add(materialise(texts, "history-texts"), materialise(ids, "history-ids"))

    def _add(self, texts: DataFrame, ids: DataFrame) -> None:
        words = word_counts(texts)
        self._write({"texts": (_keyed(texts, index_keys), SEGMENTS * texts.count()), "ids": (ids, ids.count()), "words": (words, words.count())}, [])
        if len(self.folders()) > MOST_FOLDERS:
            self.compact()

    def read(self, kind: str, asked: DataFrame | None = None) -> DataFrame:
        """Rows of a kind; with ``asked``, a table with the column they are split by, only of the parts that it falls into."""
        out = None
        schema, columns = self.KINDS[kind], [c.split()[0] for c in self.KINDS[kind].split(", ")][:-1]
        for folder, parts in self.folders().items():
            df = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/{kind}")
            if asked is not None and parts[kind] > 1:
                named = sorted(r[0] for r in asked.select(self._bucket(kind, parts[kind]).alias("b")).distinct().collect())
                df = df if len(named) == parts[kind] else df.where(F.col("bucket").isin(named))
            df = df.select(*columns)
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], schema).drop("bucket") if out is None else out

    def compact(self) -> SegmentIndex:
        """All folders as one. Equal texts and ids keep their earliest ``at``; what was replaced stays on disk for those who still read it."""
        old = [*self.folders()]
        texts, ids, words = (self.read(kind) for kind in ("texts", "ids", "words"))
        n = {kind: df.count() for kind, df in (("texts", texts), ("ids", ids), ("words", words))}
        texts, ids = texts.groupBy("block", "text", "key").agg(F.min("at").alias("at")), ids.groupBy("id").agg(F.min("at").alias("at"))
        self._write({"texts": (texts, n["texts"]), "ids": (ids, n["ids"]), "words": (words.groupBy("word").agg(F.sum("n").alias("n")), n["words"])}, old)
        return self


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): in how many of the texts each word stands."""
    return texts.select(F.explode(F.array_distinct(F.split("text", " "))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def check_batch(batch: DataFrame, index: SegmentIndex, known: frozenset[str] | None = None) -> DataFrame:
    """(key, at, id, block, text) of new rows -> (key, at, repeats): whether an indexed row or an earlier row of the batch is the
    same job. ``at`` orders the batch (unique, above all indexed ones). What the index doesn't hold yet is then appended to it; a
    batch that failed can be checked again, as rows of its own ``at`` don't count.

    Null ids and titles never match; a row matches by either. Copies within the batch repeat the first of them. Words of their own
    are told by their numbers in the titles of index and batch, unless ``known`` names them.
    """
    batch = materialise(batch, "history-batch")
    own = batch.where(F.col("text").isNotNull()).groupBy("block", "text").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    own = materialise(own.withColumn("pid", F.monotonically_increasing_id()), "history-texts")
    probes = materialise(_keyed(own.select("pid", "block", "text"), probe_keys).select("pid", "key"), "history-probes")
    bits = bits_for(own.count() * KEYS, BITMAP_SLOTS, BITMAP_LEAST, BITMAP_MOST)
    asked = share(batch, key_bitmap(probes, "key", bits, mixed=True))
    slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    stored = _only(index.read("texts", own), slot, asked).unionByName(_keyed(own.select("block", "text", "at"), index_keys))
    met = probes.join(stored, "key").groupBy("pid", "block", "text").agg(F.min("at").alias("at"))
    sides = own.select("pid", F.col("block").alias("_block"), F.col("text").alias("probe"))
    met = met.join(sides, "pid").where((F.col("block") == F.col("_block")) & (F.abs(F.length("probe") - F.length("text")) <= EDITS)).select("pid", "block", "probe", "text", "at")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [differences(p, q) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            keep = pa.array([x is not None for x in pairs], pa.bool_())
            diffs = pa.array([[{"v": v, "w": w} for v, w in x] for x in pairs if x is not None], pa.list_(pa.struct([("v", pa.string()), ("w", pa.string())])))
            yield pa.RecordBatch.from_arrays([*b.filter(keep).columns, diffs], names=["pid", "block", "probe", "text", "at", "diffs"])

    near = met.mapInArrow(compared, "pid bigint, block string, probe string, text string, at bigint, diffs array<struct<v:string,w:string>>")
    near = materialise(near, "history-near")
    held = near.where(F.col("probe") == F.col("text")).join(own.select("pid", F.col("at").alias("own_at")), "pid").where(F.col("at") < F.col("own_at")).select("pid").distinct()
    fresh = materialise(own.join(held, "pid", "left_anti").select("block", "text", "at"), "history-fresh")
    doubt = near.where(F.size("diffs") > 0).select("pid", "text", F.explode("diffs").alias("d")).select("pid", "text", "d.v", "d.w")
    if known is None:
        words = doubt.select(F.explode(F.array("v", "w")).alias("word")).where("word <> ''").distinct()
        counts = index.read("words", words).unionByName(word_counts(fresh)).join(words, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
        counts = materialise(counts, "history-words")
        for side in ("v", "w"):
            doubt = doubt.join(counts.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}")), side, "left")
        low, high = F.least("n_v", F.coalesce("n_w", "n_v")), F.greatest("n_v", F.coalesce("n_w", "n_v"))
        apart = low >= F.greatest(F.lit(float(OWN_LEAST)), high * OWN_SHARE)
    else:
        listed = batch.sparkSession.createDataFrame([(w,) for w in sorted(known)], "word string")
        for side in ("v", "w"):
            doubt = doubt.join(listed.select(F.col("word").alias(side), F.lit(True).alias(f"n_{side}")), side, "left")
        apart = F.col("n_v").isNotNull() & ((F.col("w") == "") | F.col("n_w").isNotNull())
    others = doubt.where(apart).select("pid", "text").distinct()
    first = near.join(others, ["pid", "text"], "left_anti").groupBy("pid").agg(F.min("at").alias("first_title"))
    keyed = own.join(first, "pid").select(F.concat("block", F.lit("\x02"), "text").alias("title_key"), "first_title", "n")
    counts = materialise(batch.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")), "history-ids")
    id_bits = bits_for(counts.count(), BITMAP_SLOTS, BITMAP_LEAST, BITMAP_MOST)
    same_ids = share(batch, key_bitmap(counts, "id", id_bits))
    old = _only(index.read("ids", counts), F.pmod(F.xxhash64("id"), F.lit(1 << id_bits)), same_ids).groupBy("id").agg(F.min("at").alias("old_at"))
    by_id = materialise(counts.join(old, "id", "left").select(F.col("id").alias("id_key"), "n", F.least("at", "old_at").alias("first_id"), F.col("old_at").isNull().alias("new")), "history-id-firsts")
    total = batch.count()
    rows = batch.withColumn("_title", F.concat("block", F.lit("\x02"), "text"))
    rows = lookup(rows, materialise(keyed, "history-titles"), "_title", "title_key", ["first_title"], "n", total)
    rows = lookup(rows, by_id, "id", "id_key", ["first_id"], "n", total)
    repeats = F.coalesce(F.col("first_title") < F.col("at"), F.lit(False)) | F.coalesce(F.col("first_id") < F.col("at"), F.lit(False))
    index._add(fresh, by_id.where("new").select(F.col("id_key").alias("id"), F.col("first_id").alias("at")))
    return rows.select("key", "at", repeats.alias("repeats"))
