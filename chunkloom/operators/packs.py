"""Pack files: layout, building, checking, and the choice between delta and pack."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.functions import codec
from chunkloom.functions.hashing import blake3_many
from chunkloom.functions.ranges import digest
from chunkloom.model import total

_PAYLOAD = T.StructType([T.StructField("encoding", T.StringType()), T.StructField("payload", T.BinaryType())])


def encoded(objects: DataFrame, level: int = codec.LEVEL) -> DataFrame:
    """object, size, encoding, payload, stored_size: each object as a pack would hold it."""

    @F.pandas_udf(_PAYLOAD)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([codec.encode_pack(bytes(v), level) for v in values], columns=["encoding", "payload"])

    rows = objects.select("object", F.octet_length("data").cast("long").alias("size"), run("data").alias("p"))
    return rows.select("object", "size", "p.encoding", "p.payload").withColumn("stored_size", F.octet_length("payload").cast("long"))


#: Bytes after which a pack ends: a body is one row of at most two gigabytes.
PACK_BYTES = 256 << 20
#: Ids that a task of gathered() remembers at most, and bytes of data that read() returns at a time.
SEEN, READ_BYTES = 500_000, 8 << 20


def gathered(rows: DataFrame, level: int = codec.LEVEL) -> DataFrame:
    """encoded() rows of each object (object, data) of ``rows`` once, dealt by _part, the digits that name its pack: build() sends them no more.

    Copies that one task meets go before anything is sent, so that an object of many copies is sent once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            keep = []
            for k, name in enumerate(batch.column(0).to_pylist()):
                if name not in seen:
                    seen.add(name)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))
            if len(seen) > SEEN:
                seen.clear()

    few = encoded(rows.select("object", "data").mapInArrow(run, "object string, data binary"), level).withColumn("_part", _part())
    columns = [c for c in few.columns if c not in ("object", "_part")]
    return few.repartition("_part").groupBy("_part", "object").agg(*(F.first(c).alias(c) for c in columns))


def _part() -> F.Column:
    return F.substring("object", 1, 2)


def layout(entries: DataFrame, pack_of: F.Column | None = None, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """``entries`` (object, stored_size) with the pack they go to and their offset there: a running sum in the order of ids.

    Packs are cut by the first hex digits of the id unless ``pack_of`` says otherwise, so that packs are written in
    parallel, and end with the object that passes a multiple of ``pack_bytes`` (00, 00-1, 00-2, ..).
    """
    return _placed(entries, pack_of, pack_bytes).drop("_part", "_ix")


def _placed(entries: DataFrame, pack_of: F.Column | None, pack_bytes: int) -> DataFrame:
    to = _part() if pack_of is None else pack_of
    before = Window.partitionBy("_part").orderBy("object").rowsBetween(Window.unboundedPreceding, -1)
    placed = entries.withColumn("_part", to).withColumn("offset", F.coalesce(F.sum("stored_size").over(before), F.lit(0)).cast("long"))
    placed = placed.withColumn("_ix", F.floor(F.col("offset") / F.lit(pack_bytes)))
    placed = placed.withColumn("pack", F.when(F.col("_ix") == 0, F.col("_part")).otherwise(F.concat_ws("-", "_part", F.col("_ix").cast("string"))))
    return placed.withColumn("offset", F.col("offset") - F.min("offset").over(Window.partitionBy("_part", "_ix")))


def repack_candidates(representations: DataFrame) -> DataFrame:
    """Loose objects that no pack has."""
    packed = representations.where("kind = 'pack'").select("object")
    return representations.where("kind = 'loose'").select("object").distinct().join(packed, "object", "left_anti")


def build(entries: DataFrame, one_pack: bool = True, salt: str = "", pack_bytes: int = PACK_BYTES) -> DataFrame:
    """pack_file, index (JSON), body of packs of encoded() or gathered() entries; ``one_pack`` cuts them by size alone.

    A pack's name is the BLAKE3 of ``salt`` and its objects' ids.
    """
    placed = _placed(entries, F.lit("0") if one_pack else F.col("_part") if "_part" in entries.columns else None, pack_bytes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("object")
        name = "pack-" + blake3_many([(salt + "\n".join(pdf["object"])).encode()])[0]
        return pd.DataFrame({"pack_file": [f"{name}.mvpack"], "objects": [pdf[["object", "offset", "size", "stored_size", "encoding"]].rename(columns={"object": "id"}).to_dict("records")], "body": [b"".join(pdf["payload"])]})

    schema = "pack_file string, objects array<struct<id: string, offset: long, size: long, stored_size: long, encoding: string>>, body binary"
    made = placed.groupBy("_part", "_ix").applyInPandas(run, schema)
    return made.select("pack_file", F.to_json(F.struct(F.lit(2).alias("version"), "pack_file", "objects")).alias("index"), "body")


_ENTRY = "object string, offset long, size long, stored_size long, encoding string, error string"


def _entry(e: F.Column) -> F.Column:
    encoding = F.when(F.col("version") == 1, "raw").otherwise(F.coalesce(e["encoding"], F.lit("raw")))
    stored = F.when(F.coalesce(e["stored_size"], F.lit(0)) == 0, e["size"]).otherwise(e["stored_size"])
    error = (
        F.when(~F.coalesce(F.col("version").isin(1, 2), F.lit(False)), "unsupported version")
        .when(~F.coalesce(F.col("pack_file").rlike(r"^[^/\\]+$") & ~F.col("pack_file").isin("", ".", ".."), F.lit(False)), "pack file outside of its folder")
        .when(~encoding.isin("raw", "zstd"), "unknown encoding").when((encoding == "raw") & (stored != e["size"]), "raw size differs")
    )
    return F.struct(F.lower(e["id"]).alias("object"), e["offset"].alias("offset"), e["size"].alias("size"), stored.alias("stored_size"), encoding.alias("encoding"), error.alias("error"))


def entries(indexes: DataFrame) -> DataFrame:
    """Rows of pack indexes (version, pack_file, objects) with the defaults of older ones, and what is wrong with them.

    Version 1 entries are raw; a stored size of 0 means the logical size; a pack file outside of its folder, an unknown
    version or encoding and a raw entry with two sizes are errors.
    """
    return indexes.select("version", "pack_file", F.explode(F.transform("objects", _entry)).alias("e")).select("version", "pack_file", "e.*")


def lookup(indexes: DataFrame, objects: DataFrame) -> DataFrame:
    """The entry of each object (object): of several packs that hold it, the first by file name."""
    found = entries(indexes).where("error is null").join(objects.select("object").distinct(), "object", "left_semi")
    return found.groupBy("object").agg(F.min(F.struct("pack_file", "offset", "size", "stored_size", "encoding")).alias("e")).select("object", "e.*")


def _decoded(encoding: str, payload: memoryview, size: int) -> bytes | None:
    try:
        return codec.decode_pack(encoding, bytes(payload), size)
    except Exception:  # noqa: BLE001  any damage makes the entry unreadable
        return None


def read(indexes: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """entries() with data (null: unreadable). bodies: pack_file, body; None if the rows of indexes have their body.

    A body stays one row next to its index until the bytes of its entries are cut from it.
    """
    rows = indexes if bodies is None else indexes.join(bodies.select("pack_file", "body"), "pack_file", "left")
    rows = rows.select(F.col("version").cast("int").alias("version"), "pack_file", F.transform("objects", _entry).cast(f"array<struct<{_ENTRY.replace(' ', ': ')}>>".replace(",: ", ", ")).alias("e"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                found = batch.column(2)[row].values
                if found is None or len(found) == 0:
                    continue
                body = batch.column(3)[row]
                whole = memoryview(body.as_buffer()) if body.is_valid else None
                fields = {f.name: found.field(f.name) for f in found.type}
                error, data = fields["error"].to_pylist(), []
                sums, lo = 0, 0
                for k, (offset, size, stored, encoding) in enumerate(zip(*(fields[n].to_pylist() for n in ("offset", "size", "stored_size", "encoding")), strict=True)):
                    value = None
                    if error[k] is None and whole is None:
                        error[k] = "missing pack"
                    elif error[k] is None and not (None not in (offset, stored) and offset >= 0 and offset + stored <= len(whole)):
                        error[k] = "entry outside of the pack"
                    elif error[k] is None:
                        value = _decoded(encoding, whole[offset : offset + stored], size)
                    data.append(value)
                    sums += len(value or b"")
                    if sums > READ_BYTES or k == len(found) - 1:
                        n = k + 1 - lo
                        columns = [*(pa.repeat(batch.column(c)[row], n) for c in (0, 1)), *(fields[x].slice(lo, n) for x in ("object", "offset", "size", "stored_size", "encoding"))]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(error[lo : k + 1], pa.string()), pa.array(data, pa.binary())], names=[*names, "data"])
                        sums, lo, data = 0, k + 1, []

    names = ["version", "pack_file", *(x.split()[0] for x in _ENTRY.split(", "))]
    return rows.mapInArrow(run, f"version int, pack_file string, {_ENTRY}, data binary")


def verify(indexes: DataFrame, bodies: DataFrame | None = None, hash: str = "blake3") -> DataFrame:
    """pack_file, object, error (null: sound) of every entry; indexes and bodies as for read()."""
    rows = read(indexes, bodies)
    wrong = F.when(F.col("data").isNull(), "unreadable entry").when(digest(F.col("data"), hash) != F.col("object"), "hash differs")
    return rows.select("pack_file", "object", F.coalesce("error", wrong).alias("error"))


def verify_totals(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.countDistinct("pack_file").alias("packs"), F.count("*").alias("entries"), F.count("error").alias("errors"), (F.count("error") == 0).alias("ok"))


def choose(representations: DataFrame, packed: DataFrame) -> DataFrame:
    """object, choice, stored_size: keep the delta where it is smaller than the pack form (object, stored_size), else pack."""
    delta = representations.where("kind = 'delta'").groupBy("object").agg(F.min("stored_size").alias("delta_size"))
    both = packed.select("object", F.col("stored_size").alias("pack_size")).join(delta, "object", "left")
    keep = F.coalesce(F.col("delta_size") < F.col("pack_size"), F.lit(False))
    return both.select("object", F.when(keep, "delta").otherwise("pack").alias("choice"), F.when(keep, F.col("delta_size")).otherwise(F.col("pack_size")).alias("stored_size"))


def choose_totals(choices: DataFrame) -> DataFrame:
    of = lambda kind, value: total(F.when(F.col("choice") == kind, value).otherwise(0))
    return choices.agg(*(of(k, v).alias(f"{k}_{n}") for k in ("delta", "pack") for n, v in (("objects", F.lit(1)), ("bytes", F.col("stored_size")))))


def recompress(loose: DataFrame, mode: str, level: int = codec.LEVEL, hash: str = "blake3") -> DataFrame:
    """object, before, stored (null: damaged, to be left alone): loose objects (object, stored) in another encoding."""

    @F.pandas_udf(T.StructType([T.StructField("data", T.BinaryType()), T.StructField("stored", T.BinaryType())]))
    def run(values: pd.Series) -> pd.DataFrame:
        def one(v: bytes) -> tuple:
            try:
                data = codec.decode_loose(bytes(v))
                return data, codec.encode_loose(data, mode, level)
            except Exception:  # noqa: BLE001
                return None, None

        return pd.DataFrame([one(v) for v in values], columns=["data", "stored"])

    rows = loose.select("object", F.octet_length("stored").cast("long").alias("before"), run("stored").alias("r"))
    return rows.select("object", "before", F.when(digest(F.col("r.data"), hash) == F.col("object"), F.col("r.stored")).alias("stored"))
