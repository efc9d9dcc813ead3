"""Result documents of any size: one JSON document per (run, benchmark), its predictions streamed past.

The predictions of a document are a table of their own beside it. Writing sorts that table by document and streams it
into the file; reading splits a document into its head and one text per prediction. Neither ever holds a document, an
array of predictions or their text as one value, so memory does not grow with a result. A document is still the work
of one task at a time, as it is one file; documents go to tasks by the hash of their name.
"""

from __future__ import annotations

import codecs
import json
import lzma
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.schema import PREDICTION, RESULT
from tallyloom.session import released, shared_path
from tallyloom.sources.bundles import MAX_DECODER_MEMORY, list_bundles, strict_json

CHUNK = 1 << 20
# Tasks per core that documents are read or written in at most, so that long ones and short ones even out.
FILES_AT_ONCE = 32
# Hash chains instead of binary trees: a fraction of the time, and files of about the same size.
PRESET = 2
SPACE = " \t\n\r"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and its name there; names may hold characters that a URI would not."""
    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, _, rest = path.partition("://")
    authority, _, name = rest.partition("/")
    store, top = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, f"{top.rstrip('/')}/{name}"


def text_chunks(path: str) -> Iterator[str]:
    """The text of a plain or XZ file, piece by piece."""
    store, name = _open(path)
    utf8 = codecs.getincrementaldecoder("utf-8")()
    decoder = lzma.LZMADecompressor(format=lzma.FORMAT_XZ, memlimit=MAX_DECODER_MEMORY) if path.endswith(".xz") else None
    with store.open_input_stream(name, compression=None) as file:
        while data := file.read(CHUNK):
            if decoder is None:
                yield utf8.decode(data)
                continue
            if decoder.eof:
                raise ValueError("truncated stream or trailing data")
            yield utf8.decode(decoder.decompress(data, CHUNK))
            while not decoder.needs_input and not decoder.eof:
                yield utf8.decode(decoder.decompress(b"", CHUNK))
    if decoder is not None and (not decoder.eof or decoder.unused_data):
        raise ValueError("truncated stream or trailing data")
    yield utf8.decode(b"", final=True)


class _Reader:
    """Raw texts of JSON values from pieces of text."""

    def __init__(self, chunks: Iterator[str]):
        self.chunks, self.text, self.at = iter(chunks), "", 0
        self.decode = json.JSONDecoder().raw_decode

    def more(self) -> bool:
        for piece in self.chunks:
            if piece:
                self.text, self.at = self.text[self.at :] + piece, 0
                return True
        return False

    def peek(self) -> str:
        """The next character that is no space; empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in SPACE:
                self.at += 1
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]

    def take(self, expected: str) -> str:
        found = self.peek()
        if not found or found not in expected:
            raise ValueError("invalid JSON")
        self.at += 1
        return found

    def value(self) -> str:
        self.peek()
        while True:
            try:
                _, end = self.decode(self.text, self.at)
            except ValueError:
                if not self.more():
                    raise ValueError("invalid JSON") from None
                continue
            # A number may go on in the next piece.
            if (end < len(self.text) and self.text[end] not in "0123456789.eE+-") or not self.more():
                text, self.at = self.text[self.at : end], end
                return text

    def elements(self) -> Iterator[str]:
        """Raw texts of the elements of an array whose bracket was taken."""
        scan = json.JSONDecoder().scan_once
        while self.peek() != "]":
            # Objects that lie whole in the piece, with a comma behind them.
            text, at = self.text, self.at
            try:
                while text[at] == "{":
                    _, end = scan(text, at)
                    if text[end] != ",":
                        break
                    yield text[at:end]
                    at = end + 1
            except (IndexError, StopIteration, ValueError):
                pass
            self.at = at
            if self.peek() == "]":
                return
            yield self.value()
            if self.peek() != "]":
                self.take(",")


def split_document(chunks: Iterator[str]) -> Iterator[tuple[str, str]]:
    """("prediction", text) per element of the object's `predictions`, last ("head", the object without them)."""
    reader, head, seen = _Reader(chunks), [], False
    reader.take("{")
    while reader.peek() != "}":
        name = reader.value()
        if not name.startswith('"'):
            raise ValueError("invalid JSON")
        reader.take(":")
        if json.loads(name) == "predictions" and reader.peek() == "[":
            if seen:
                raise ValueError("invalid JSON")
            seen = True
            reader.take("[")
            for element in reader.elements():
                yield "prediction", element
            reader.take("]")
        else:
            head.append(f"{name}:{reader.value()}")
        if reader.peek() != "}":
            reader.take(",")
    reader.take("}")
    if reader.peek():
        raise ValueError("invalid JSON")
    yield "head", "{" + ",".join(head) + "}"


def _split_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, kind, text); a file that cannot be read ends with kind `problem`."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            held: list[tuple[str, str]] = []
            size = 0

            def rows(parts: list[tuple[str, str]], path: str = path) -> pa.RecordBatch:
                kinds, texts = zip(*parts, strict=True)
                return pa.RecordBatch.from_arrays([pa.array([path] * len(parts)), pa.array(kinds), pa.array(texts)], names=["path", "kind", "text"])

            try:
                for part in split_document(text_chunks(path)):
                    held.append(part)
                    size += len(part[1])
                    if size >= CHUNK:
                        yield rows(held)
                        held, size = [], 0
            except lzma.LZMAError:
                held.append(("problem", "not an XZ stream"))
            except UnicodeDecodeError:
                held.append(("problem", "not UTF-8"))
            except ValueError as problem:
                held.append(("problem", str(problem)))
            if held:
                yield rows(held)


def result_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, source, problem): the result files that count below some folders, by the published-folder rule.

    In a folder with a metadata file only the archives are results; a plain copy beside them is none. In any other
    folder plain files are results, and an archive is a problem. `source` is the name of the folder given.
    """
    archive = F.endswith("path", F.lit(".xz"))
    parts = [list_bundles(spark, r).withColumn("source", F.lit(r.rstrip("/").rsplit("/", 1)[-1])) for r in roots]
    listed = reduce(DataFrame.unionByName, parts).where(archive | ~F.col("published"))
    problem = F.when(archive & ~F.col("published"), F.lit("archive without metadata"))
    return listed.select("path", "source", problem.alias("problem"))


def source_counts(files: DataFrame) -> DataFrame:
    """Result files per source."""
    return files.groupBy("source").agg(F.count(F.lit(1)).alias("files"))


def _tasks(documents: DataFrame) -> int:
    """Over how many tasks documents are dealt, so that Spark does not put them together by their sizes."""
    return max(1, min(documents.count(), FILES_AT_ONCE * documents.sparkSession.sparkContext.defaultParallelism))


def read_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, predictions) of result_files().

    Heads have `path`, `problem` and the parsed `result` without predictions. Predictions are those of documents without
    a problem, also of their own: (run_id, benchmark_id, case_id, ...). Files are read once; their texts go to the
    shared folder.
    """
    spark = files.sparkSession
    folder = shared_path(spark, "documents")
    # The list of files is a small table, the files are not: they are dealt out evenly.
    sound_files = files.where("problem is null").select("path")
    # A task holds one piece of one document, whatever number of files it gets.
    split = sound_files.repartition(_tasks(sound_files)).mapInArrow(_split_files, "path string, kind string, text string")
    # Texts are judged while they are at hand, so that the broken ones are found without reading them all again.
    judged = split.withColumn("sound", strict_json(F.col("text")).isNotNull())
    with released(spark):
        judged.write.partitionBy("kind").parquet(folder)
    texts = spark.read.schema("path string, text string, sound boolean, kind string").parquet(folder)
    sound = F.col("sound")
    broken = texts.where("kind = 'prediction'").where(~sound).select("path").distinct()
    problems = (
        texts.where("kind = 'problem'").select("path", F.col("text").alias("problem"))
        .unionByName(files.where("problem is not null").select("path", "problem"))
        .unionByName(broken.withColumn("problem", F.lit("invalid JSON")))
    )
    head = texts.where("kind = 'head'").join(broken, "path", "left_anti")
    parsed = head.select(
        "path",
        F.when(~sound, F.lit("invalid JSON")).alias("problem"),
        F.when(sound, F.from_json("text", RESULT)).alias("result"),
    )
    heads = parsed.unionByName(problems.withColumn("result", F.lit(None).cast(RESULT)))
    owner = parsed.where("problem is null").select(
        F.col("path").alias("_path"), F.col("result.run_id").alias("run_id"), F.col("result.benchmark.id").alias("benchmark_id")
    )
    rows = texts.where("kind = 'prediction'").join(owner, F.col("path") == F.col("_path"))
    predictions = rows.select("run_id", "benchmark_id", F.from_json("text", PREDICTION).alias("p"))
    return heads, predictions.select("run_id", "benchmark_id", "p.*")


def write_result_documents(
    heads: DataFrame, predictions: DataFrame, root: str, compressed: bool = True, fields: list[str] | None = None
) -> None:
    """`<run_id>/<benchmark id>.json[.xz]` for each row of `heads` (run_id, benchmark_id, result struct).

    `predictions` has (run_id, benchmark_id) and `fields`; those of a document are ordered by case and question and
    follow its head. A prediction without a head is an error. A file appears under its name only when whole.
    """
    base = root.rstrip("/")
    fields = fields or [f.name for f in PREDICTION.fields]
    suffix = ".json.xz" if compressed else ".json"
    name = F.concat("run_id", F.lit("/"), "benchmark_id", F.lit(suffix)).alias("name")
    none = F.lit("")

    def text(value: Column | str) -> Column:
        return F.to_json(value, {"ignoreNullFields": "false"}).alias("text")

    rows = heads.select(name, F.lit(0).alias("part"), none.alias("case"), none.alias("question"), text("result")).unionByName(
        predictions.select(
            name, F.lit(1).alias("part"), F.col("case_id").alias("case"), F.col("question_id").alias("question"), text(F.struct(*fields))
        )
    )

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(base)
        file = packer = current = staged = None
        first = True

        def put(piece: str) -> None:
            data = piece.encode("utf-8")
            file.write(packer.compress(data) if packer else data)

        def begin(document: str, head: str) -> None:
            nonlocal file, packer, current, staged, first
            current, first = document, True
            store.create_dir(f"{folder}/{document}".rsplit("/", 1)[0], recursive=True)
            staged = f"{folder}/{document}.{uuid.uuid4().hex}.tmp"
            file = store.open_output_stream(staged, compression=None)
            packer = lzma.LZMACompressor(preset=PRESET) if document.endswith(".xz") else None
            put((head[:-1] + "," if head != "{}" else "{") + '"predictions":[')

        def finish() -> None:
            nonlocal file
            if file is None:
                return
            put("]}")
            if packer:
                file.write(packer.flush())
            file.close()
            file = None
            store.move(staged, f"{folder}/{current}")

        try:
            for batch in batches:
                done, at = [], 0
                # Rows of one document are a stretch of the batch and go into the file at once.
                stretches = pc.run_end_encode(batch.column(0))
                for document, to in zip(stretches.values.to_pylist(), stretches.run_ends.to_pylist(), strict=True):
                    heads = pc.sum(pc.equal(batch.column(1).slice(at, to - at), 0)).as_py()
                    pieces = batch.column(2).slice(at, to - at).to_pylist()
                    at = to
                    if document is None or document != current:
                        finish()
                        if heads == 0:
                            raise ValueError(f"Predictions without a result: {document}")
                        begin(document, pieces[0])
                        done.append(document)
                        heads, pieces = heads - 1, pieces[1:]
                    if heads:
                        raise ValueError(f"Two results: {document}")
                    if pieces:
                        put(("" if first else ",") + ",".join(pieces))
                        first = False
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["name"])
            finish()
        finally:
            if file is not None:
                file.close()

    ordered = rows.repartition(_tasks(heads), "name").sortWithinPartitions("name", "part", "case", "question")
    with released(heads.sparkSession):
        ordered.select("name", "part", "text").mapInArrow(save, "name string").write.format("noop").mode("overwrite").save()
