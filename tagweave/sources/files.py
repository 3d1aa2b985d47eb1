"""Reading pools, manifests, catalogues and vocabularies from storage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tagweave.cluster import stored
from tagweave.errors import CurationError
from tagweave.functions import names, variants
from tagweave.functions.text import strip
from tagweave.operators import predictions
from tagweave.sources.headers import image_headers


def list_files(spark: SparkSession, folder: str, *, recursive: bool = False) -> DataFrame:
    """Path and length of every file; contents are never read.

    Spark hides names that start with ``_`` or ``.``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", "length")


def decoded_path() -> Column:
    """File path of a text scan; ``_metadata.file_path`` comes URL-encoded."""
    # A plus sign is not encoded there, yet decoding would turn it into a space.
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_metadata(spark: SparkSession, folder: str, *, recursive: bool = False) -> DataFrame:
    """JSON records ``(path, stem, meta VARIANT)``; NULL where unusable."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option(
        "pathGlobFilter", "*.json"
    )
    path = F.col("path")
    return (
        reader.text(folder, wholetext=True)
        .select(decoded_path().alias("path"), "value")
        .select(
            "path",
            names.stem(names.file_name(path)).alias("stem"),
            variants.parse_object(F.col("value")).alias("meta"),
        )
    )


def metadata_rejects(metadata: DataFrame) -> DataFrame:
    return metadata.where(F.col("meta").isNull()).select("path", "stem")


def show(metadata: DataFrame, stem: str) -> DataFrame:
    """Metadata of one candidate as JSON text; fails when there is none."""
    found = metadata.where(F.col("stem") == stem)
    if not found.take(1):
        raise CurationError(f"Candidate metadata not found: {stem}")
    return found.select("stem", F.to_json("meta").alias("json"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``(path, row VARIANT)`` of JSON-lines files, and the bad lines.

    Rejects carry their line number. Lines are counted per file split and
    offset by the splits before, so large files stay split.
    """
    lines = spark.read.text(path).select(
        decoded_path().alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    parsed = lines.where(strip(F.col("value")) != "").select(
        "path", "split", "seq", "value", variants.parse_strict(strip(F.col("value"))).alias("row")
    )
    good = parsed.where(variants.is_object(F.col("row"))).select("path", "row")
    bad = parsed.where(~variants.is_object(F.col("row")))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    splits = (
        lines.groupBy("path", "split")
        .agg(F.min("seq").alias("first"), F.count("*").alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    rejects = bad.join(splits, ["path", "split"]).select(
        "path",
        (F.col("offset") + F.col("seq") - F.col("first") + 1).alias("line"),
        F.when(F.col("row").isNull(), "invalid JSON").otherwise("not a JSON object").alias("reason"),
        "value",
    )
    return good, rejects


# --- download catalogue -----------------------------------------------------

def is_catalogue(spark: SparkSession, folder: str) -> bool:
    """A manifest file beside an ``images`` and a ``json`` folder."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def is_dir(name: str) -> bool:
        child = fs_path(root, name)
        return fs.exists(child) and fs.getFileStatus(child).isDirectory()

    return fs.exists(fs_path(root, "manifest.json")) and is_dir("images") and is_dir("json")


#: Members of a catalogue that are read.
_MEMBERS = ("queries", "posts")
#: Running sums start anew after so many pieces (2 to this power), which a window holds at once; a piece of text is about 50 bytes.
_BLOCK_BITS = 12
_BLOCK = ["block", "split", "file"]
#: Bytes of a document in one task; its pieces take several times as much.
_TASK_BYTES = 16 << 20


def _parts(frame: DataFrame) -> int:
    """Partitions to deal the text of the files of ``frame`` to, however few the session asks for."""
    spark = frame.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)) for file in frame.inputFiles()]
    conf = spark._jsc.hadoopConfiguration()
    size = sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // _TASK_BYTES)


def _earlier_blocks() -> WindowSpec:
    """The blocks of a file that come before one."""
    return Window.partitionBy("file").orderBy("split", "block").rowsBetween(Window.unboundedPreceding, -1)


def _sum_over(value: Column, window: WindowSpec) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def _count(text: Column, *characters: str) -> Column:
    return reduce(Column.__add__, [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in characters])


def _opened(text: Column) -> Column:
    return _count(text, "[", "{") - _count(text, "]", "}")


def _cut_at_commas(texts: DataFrame, parts: int) -> DataFrame:
    """Pieces of JSON documents between commas, with what stands around them.

    ``inside`` tells whether a piece begins within a string, ``depth`` in how many brackets, ``delta`` how many it opens.
    Both are running sums over the pieces of a block, which start from the sums of the blocks before, so tasks get blocks dealt out
    evenly and no window holds more than one. Files whose brackets do not close have no pieces.
    """
    seq = F.col("seq")
    pieces = texts.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"), "value",
    ).withColumn("block", F.shiftright(seq, _BLOCK_BITS))
    before = Window.partitionBy(*_BLOCK).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)

    escaped = F.contains("value", F.lit("\\"))
    plain, flips = F.col("plain"), F.col("flips")
    # the text alone is shuffled; what is told from it is told anew by each reader of the shuffle
    told = (
        pieces.repartition(parts, *_BLOCK)
        .withColumn("plain", F.when(escaped, F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value")))
        .withColumn("flips", _count(plain, '"'))
        .withColumn("opens", _opened(plain))
        .withColumn("unquoted", F.when(flips > 0, F.regexp_replace(plain, '"[^"]*("|$)', "")).otherwise(plain))
        .withColumn("outer", _opened(F.col("unquoted")))
        .withColumn("odd", _sum_over(flips, before) % 2 == 1)
    )
    # brackets within strings are those that are not outside of them; a piece that begins within a string has them the other way round
    odd, outer, inner = F.col("odd"), F.col("outer"), F.col("opens") - F.col("outer")
    told = told.withColumn("if_outside", F.when(odd, inner).otherwise(outer)).withColumn("if_inside", F.when(odd, outer).otherwise(inner))
    blocks = (
        told.groupBy(*_BLOCK)
        .agg(F.sum("flips").alias("flips"), F.sum("if_outside").alias("if_outside"), F.sum("if_inside").alias("if_inside"))
        .withColumn("from_inside", _sum_over(F.col("flips"), _earlier_blocks()) % 2 == 1)
        .withColumn("gain", F.when(F.col("from_inside"), F.col("if_inside")).otherwise(F.col("if_outside")))
        .withColumn("from_depth", _sum_over(F.col("gain"), _earlier_blocks()))
    )
    whole = blocks.groupBy("file").agg(F.sum("flips").alias("flips"), F.sum("gain").alias("gain")).where("flips % 2 = 0 AND gain = 0")
    starts = blocks.join(whole.select("file"), "file", "left_semi").select(*_BLOCK, "from_inside", "from_depth")
    delta = F.when(F.col("from_inside"), F.col("if_inside")).otherwise(F.col("if_outside"))
    return (
        # one row for thousands of pieces
        told.join(F.broadcast(starts), _BLOCK)
        .withColumn("inside", F.col("odd") != F.col("from_inside"))
        .withColumn("delta", delta)
        .withColumn("depth", F.col("from_depth") + _sum_over(F.col("delta"), before))
        .select(*_BLOCK, "seq", "value", "plain", "inside", "depth", "delta")
    )


def _catalogue_units(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Small catalogues ``(unit, member, c VARIANT)`` of an entry each, and the whole numbers cut out of their id lists.

    Numbers ``(unit, post_id)`` come apart because one list may be as long as the catalogue. The pieces are written once
    with the entry that each belongs to, and entries and numbers read from there.
    """
    document = spark.read.option("lineSep", ",").text(path)
    parts = _parts(document)
    pieces = _cut_at_commas(document, parts)
    outside = ~F.col("inside")
    number = outside & (F.col("depth") == 4) & F.col("value").rlike(r"^\s*-?[0-9]+\s*$")
    member = F.regexp_extract("plain", rf'^\s*\{{?\s*"({"|".join(_MEMBERS)})"\s*:', 1)
    listing = F.contains("plain", F.lit("seen_post_ids")) & F.col("plain").rlike(r'"seen_post_ids"\s*:\s*\[[^\[\]{}:]*$') & (F.col("depth") + F.col("delta") == 4)
    told = {
        "unit": F.when(outside & (F.col("depth") <= 2), F.col("seq")),
        "member": F.when(outside & (F.col("depth") <= 1), member),
        # elements of a list leave it open
        "listing": F.when(F.col("plain").rlike(r"[\[\]{}:]"), listing),
    }
    so_far = Window.partitionBy(*_BLOCK).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = pieces.select(
        *_BLOCK, "seq", "value", "depth", "delta", number.alias("number"),
        *[F.last(value, ignorenulls=True).over(so_far).alias(name) for name, value in told.items()],
    )
    ends = marked.groupBy(*_BLOCK).agg(*[F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name) for name in told])
    heads = ends.select(*_BLOCK, *[F.last(name, ignorenulls=True).over(_earlier_blocks()).alias(f"head_{name}") for name in told])
    # one row for thousands of pieces
    full = stored(marked.join(F.broadcast(heads), _BLOCK).select(
        "split", "seq", "value", "depth", "delta", "number", *[F.coalesce(name, f"head_{name}").alias(name) for name in told]
    ).where(F.col("member").isin(*_MEMBERS)))
    texts = (
        full.where(~F.col("number"))
        .repartition(parts, "unit")
        .groupBy("unit", "member")
        .agg(
            F.array_sort(F.collect_list(F.struct("split", "seq", "value"))).alias("pieces"),
            F.min_by("depth", F.struct("split", "seq")).alias("depth"), F.sum("delta").alias("delta"),
        )
        .withColumn("text", F.array_join(F.transform("pieces", lambda p: p["value"]), ","))
    )
    opening = F.when(F.col("depth") == 0, "").when(F.col("depth") == 1, "{").otherwise(F.concat(F.lit('{"'), "member", F.lit('":{')))
    document = F.concat(opening, "text", F.repeat(F.lit("}"), (F.col("depth") + F.col("delta")).cast("int")))
    units = texts.select("unit", "member", F.try_parse_json(document).alias("c"))
    numbers = full.where(F.col("number") & F.col("listing") & (F.col("member") == "queries"))
    return units, numbers.select("unit", F.expr("try_cast(trim(value) AS BIGINT)").alias("post_id"))


def _entries(spark: SparkSession, units: DataFrame, member: str) -> DataFrame:
    """Rows ``(unit, key, value VARIANT)`` of one member of a catalogue."""
    whole = units.where(F.col("member") == member).select("unit", F.try_variant_get("c", f"$.{member}", "variant").alias("entries"))
    each = whole.lateralJoin(spark.tvf.variant_explode(F.col("entries").outer()))
    return each.select("unit", "key", "value")


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``query_seen(query_key, post_id)`` and ``post_paths(post_id, mode, path)``.

    The mode ``json`` names the record of a post. The catalogue is one JSON document of any size and layout; all cores read
    splits of it, and no window holds more than a block of thousands of pieces, nor a row more than an entry. The pieces are written
    below ``spark.checkpoint.dir`` when this is called. A document whose brackets do not close gives
    no rows; entries that are no JSON are left out.
    """
    units, numbers = _catalogue_units(spark, path)
    ids = F.try_variant_get("value", "$.seen_post_ids", "array<bigint>")
    listed = _entries(spark, units, "queries").select("unit", F.col("key").alias("query_key"), ids.alias("ids")).where("ids IS NOT NULL")
    seen = (
        listed.select("query_key", F.explode("ids").alias("post_id"))
        .unionByName(numbers.join(listed.select("unit", "query_key"), "unit").select("query_key", "post_id"))
        .where(F.col("post_id").isNotNull())
    )
    modes = {"json": "$.file_paths.json"} | {m: f"$.file_paths.image_paths.{m}" for m in ("preview", "sample", "original")}
    paths = F.array(
        *[F.struct(F.lit(m).alias("mode"), F.try_variant_get("value", at, "string").alias("path")) for m, at in modes.items()]
    )
    posts = (
        _entries(spark, units, "posts")
        .select(F.expr("try_cast(key AS BIGINT)").alias("post_id"), F.explode(paths).alias("file"))
        .where(F.col("post_id").isNotNull() & F.col("file.path").isNotNull())
        .select("post_id", "file.mode", "file.path")
    )
    return seen, posts


# --- vocabulary and image sizes ---------------------------------------------


def _numbered(rows: DataFrame) -> DataFrame:
    # A vocabulary is one short file; its row order is its meaning.
    return rows.withColumn("pos", F.row_number().over(Window.orderBy("_at")) - 1).drop("_at")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant label list ``(pos, name, normalized, category, category_name)``."""
    raw = spark.read.csv(path, header=True).withColumn("pos", F.monotonically_increasing_id())
    kept = predictions.vocabulary(raw).withColumnRenamed("pos", "_at")
    return _numbered(kept)


def read_strict_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Label list ``(pos, name, category)``; both columns must be there."""
    raw = spark.read.csv(path, header=True)
    missing = sorted({"name", "category"} - set(raw.columns))
    if missing:
        raise CurationError(f"Tag list is missing columns: {', '.join(missing)}")
    return _numbered(
        raw.select(
            "name",
            F.col("category").cast("int").alias("category"),
            F.monotonically_increasing_id().alias("_at"),
        )
    )


def read_image_sizes(spark: SparkSession, folder: str, *, recursive: bool = False) -> DataFrame:
    """``(path, length, width, height, mode, has_transparency)`` of every file, from headers alone; see :mod:`tagweave.sources.headers`.

    Knows PNG, JPEG, GIF, BMP and WebP. Files without a readable header have NULL for all but path and length.
    """
    spark.dataSource.register(image_headers())
    return spark.read.format("image_headers").option("recursive", str(recursive).lower()).load(folder)
