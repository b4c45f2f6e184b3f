"""Result sinks: table, alignments, reactivity JSON, parameters."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profseek.functions.scalars import display_bases
from profseek.functions.shared import broadcast_if_small, file_uri, filesystem, fresh_path
from profseek.operators import tiles
from profseek.operators.gapped import gapped_bases, gapped_json
from profseek.operators.tiles import is_long
from profseek.sources.load import first_by_id

AUTHOR = "profseek"
# fixed values: per-file annotation tags of the Stockholm format used here
GF_ID, GF_AUTHOR, GC_STRUCTURE = "#=GF ID ", "#=GF AU ", "#=GC SS_cons"


def prepare_output(path: str, overwrite: bool) -> None:
    """Create the output folder; an existing one needs `overwrite` and is emptied."""
    from pyarrow.fs import FileType

    fs, inner = filesystem(path)
    if fs.get_file_info(inner).type != FileType.NotFound:
        if not overwrite:
            raise FileExistsError(path)
        fs.delete_dir_contents(inner)
    fs.create_dir(inner, recursive=True)


def write_text(path: str, text: str) -> None:
    fs, inner = filesystem(path)
    with fs.open_output_stream(inner) as out:
        out.write(text.encode())


def write_table(table: DataFrame, path: str, single_file: bool = False) -> None:
    """Tab-separated table, as a folder of ordered parts with headers, or as one file.

    Empty cells stay empty; cells with a separator, quote or line break are
    quoted, quotes doubled. For one file the parts are written first, and a task
    joins them as streams; an empty table then is the bare header.
    """
    names = ["" if c == "status" else c for c in table.columns]
    cell = lambda c: F.when(c.rlike('[\t"\n\r]'), F.concat(
        F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)
    line = F.concat_ws("\t", *[F.coalesce(cell(F.col(f"`{c}`").cast("string")), F.lit("")) for c in table.columns])
    rows = table.select(line.alias("value"))
    if not single_file:
        table.withColumnRenamed("status", " ").write.mode("overwrite").options(
            sep="\t", header="true", emptyValue="", escape='"').csv(path)
        return
    parts = fresh_path(table.sparkSession, "results")
    rows.write.text(parts)
    source, target, head = file_uri(parts), file_uri(path), "\t".join(names).encode()

    def join(batches):
        from pyarrow.fs import FileSelector

        for _ in batches:
            (fs, inner), (out_fs, out) = filesystem(source), filesystem(target)
            files = sorted(f.path for f in fs.get_file_info(FileSelector(inner)) if f.base_name.startswith("part-"))
            with out_fs.open_output_stream(out) as stream:
                stream.write(head)
                first = True
                for file in files:
                    with fs.open_input_stream(file) as part:
                        while chunk := part.read(1 << 20):
                            stream.write(b"\n" + chunk if first else chunk)
                            first = False
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["n"])

    table.sparkSession.range(1).coalesce(1).mapInArrow(join, "n long").collect()


def file_stem():
    """Name shared by all files of a hit."""
    return F.format_string("%s_%d-%d_%s_%d-%d", "target_id", "d_start", "d_end", "query_id", "q_start", "q_end")


def _with_target_parts(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Bases and values of the aligned target ranges, from the pieces that each range meets."""
    ids = hits.select(F.col("target_id").alias("id")).distinct()
    size, key = tiles.PIECE, ["target_id", "d_start", "d_end"]
    cut = tiles.pieces(rows.join(broadcast_if_small(ids), "id", "left_semi"), size).select(
        "target_id", "tile", "bases", "reactivity")
    spans = hits.select(*key).distinct().withColumn("tile", F.explode(F.sequence(
        F.floor(F.col("d_start") / size), F.floor(F.col("d_end") / size))))
    at = F.greatest(F.col("d_start") - F.col("tile") * size, F.lit(0)).cast("int")
    n = F.least(F.col("d_end") + 1 - F.col("tile") * size, F.lit(size)).cast("int") - at
    met = spans.join(cut, ["target_id", "tile"]).select(*key, F.struct(
        "tile", F.substring(F.col("bases"), at + 1, n).alias("b"), F.slice("reactivity", at + 1, n).alias("v")).alias("p"))
    parts = met.groupBy(*key).agg(F.array_sort(F.collect_list("p")).alias("p")).select(
        *key, F.array_join(F.col("p.b"), "").alias("d_bases"), F.flatten(F.col("p.v")).alias("d_values"),
        F.lit("DNA").alias("d_molecule"))
    return hits.join(parts, key)


def with_records(hits: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Significant hits with the original bases and values of both aligned ranges.

    The stored hits say which records are needed; of several with one name the first counts.
    Targets in long form must have distinct names; they are cut piece by piece.
    """
    out = hits.where(F.col("status") == "!")
    if is_long(targets):
        out, sides = _with_target_parts(out, targets), ((queries, "query_id", "q"),)
    else:
        sides = ((queries, "query_id", "q"), (targets, "target_id", "d"))
    for frame, key, side in sides:
        ids = out.select(F.col(key).alias("id")).distinct()
        frame = first_by_id(frame.join(broadcast_if_small(ids), "id", "left_semi"))
        out = out.join(frame.select(F.col("id").alias(key), F.col("bases").alias("_b"), F.col("reactivity").alias("_v"),
                                    F.col("molecule").alias(f"{side}_molecule")), key)
        at = (F.col(f"{side}_start") + 1).cast("int")
        n = (F.col(f"{side}_end") - F.col(f"{side}_start") + 1).cast("int")
        out = out.withColumn(f"{side}_bases", F.substring(F.col("_b"), at, n)).withColumn(
            f"{side}_values", F.slice("_v", at, n)).drop("_b", "_v")
    return out


def _aligned(side: str, path: str):
    return gapped_bases(display_bases(F.col(f"{side}_bases"), F.col(f"{side}_molecule")), F.col(path))


def fasta_text():
    return F.format_string(">%s\n%s\n>%s\n%s\n", F.col("target_id"), _aligned("d", "t_path"), F.col("query_id"),
                           _aligned("q", "q_path"))


def stockholm_text(with_structure: bool = False):
    width = F.greatest(F.length("target_id"), F.length("query_id"), F.lit(len(GC_STRUCTURE))) + 1
    lines = [F.lit("# STOCKHOLM 1.0"), F.concat(F.lit(GF_ID), file_stem()), F.lit(GF_AUTHOR + AUTHOR), F.lit(""),
             F.concat(F.rpad(F.col("target_id"), width, F.lit(" ")), _aligned("d", "t_path")),
             F.concat(F.rpad(F.col("query_id"), width, F.lit(" ")), _aligned("q", "q_path"))]
    if with_structure:
        lines.append(F.when(F.col("dotbracket").isNotNull(), F.concat(
            F.rpad(F.lit(GC_STRUCTURE), width, F.lit(" ")), F.col("dotbracket"))))
    return F.concat_ws("\n", *lines, F.lit("//\n"))


def reactivity_json():
    quote = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    parts = []
    for label, side, path, key in (("query", "q", "q_path", "query_id"), ("target", "d", "t_path", "target_id")):
        parts += [F.lit(f'"{label}":'), gapped_json(F.col(f"{side}_values"), F.col(path)),
                  F.lit(f',"{label}Id":'), quote(F.col(key)), F.lit(f',"{label}From":'), F.col(f"{side}_start"),
                  F.lit(f',"{label}To":'), F.col(f"{side}_end"), F.lit("," if label == "query" else "}")]
    return F.concat(F.lit("{"), *[p.cast("string") for p in parts])


def write_files(rows: DataFrame, folder: str, extension: str) -> int:
    """One file per row of (name, text), written by the tasks; writing again gives the same file."""
    target = file_uri(folder)

    def write(frames):
        fs, inner = filesystem(target)
        fs.create_dir(inner, recursive=True)
        for pdf in frames:
            for name, text in zip(pdf["name"], pdf["text"]):
                name = name.replace("%", "%25").replace("/", "%2F")  # a name is no path
                with fs.open_output_stream(f"{inner}/{name}.{extension}") as out:
                    out.write(text.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    done = rows.select("name", "text").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return int(done.first()["n"])


def write_reports(hits: DataFrame, queries: DataFrame, targets: DataFrame, out: str, cfg) -> None:
    """Alignment and reactivity files of the significant hits, as configured."""
    if cfg.report_alignment is None and not cfg.report_reactivity:
        return
    records = with_records(hits, queries, targets)
    if cfg.report_alignment:
        fasta = cfg.report_alignment == "fasta"
        text = fasta_text() if fasta else stockholm_text(cfg.eval_align_fold)
        write_files(records.select(file_stem().alias("name"), text.alias("text")), f"{out}/alignments",
                    "fasta" if fasta else "sto")
    if cfg.report_reactivity:
        write_files(records.select(file_stem().alias("name"), reactivity_json().alias("text")),
                    f"{out}/reactivities", "json")


def print_table(table: DataFrame) -> None:
    """All results on the console, partition by partition."""
    found = False
    for row in table.toLocalIterator():
        if not found:
            print("\t".join("" if c == "status" else c for c in table.columns))
            found = True
        print("\t".join("" if v is None else str(v) for v in row))
    if not found:
        print("No match found.")
