"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .credentials import credential_lines, redacted
from .documented_functions import documented_functions, documented_rows
from .leaked_passages import leak_report, leaked_passages
from .lookalikes import consistent_forms, look_classes, same_look, script_report
from .machine_files import machine_files
from .source_mixing import mix, mix_shares
from .unparsable_files import failure_rates, unparsable
from .vector_neighbours import neighbour_pairs, neighbours


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """File rows of ``code_nodes``."""
    return table(spark, folder, "code_nodes").where("type = 'File'")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of nodes of which one is among the five most similar of the other."""
    return neighbour_pairs(table(spark, folder, "code_nodes"))


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar nodes of each node, with ranks and similarities."""
    return neighbours(table(spark, folder, "code_nodes"))


def p1_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of ``p1_found`` without any loss, by the same operator's exact mode."""
    return neighbour_pairs(table(spark, folder, "code_nodes"), exact=True)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of Function and Method rows with non-trivial documentation."""
    return documented_rows(table(spark, folder, "code_nodes"))


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Code and description of each documented function, once for each File id."""
    files = _files(spark, folder).select("repository_id", "file_path", "source")
    return documented_functions(files).dropDuplicates(["repository_id", "file_path", "start_line", "name"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of File rows whose source does not parse."""
    return unparsable(_files(spark, folder))


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of files that don't parse by repository and language."""
    return failure_rates(_files(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """File id and line of every credential."""
    return credential_lines(_files(spark, folder))


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of the files that hold credentials, with these blanked out, once for each file."""
    return redacted(_files(spark, folder)).where("n_redacted > 0").dropDuplicates(["id"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of source files not written by hand for their repository."""
    return machine_files(_files(spark, folder)).select("id")


def p6_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The same files with repository_id, path and kind."""
    return machine_files(_files(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, with the item."""
    return leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Number of documents each evaluation item leaked into."""
    return leak_report(p7_found(spark, folder), table(spark, folder, "eval_items"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of each document in the mix."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached by the mix."""
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    return mix_shares(targets, mix(documents, targets))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that look the same and differ."""
    return same_look(table(spark, folder, "documents"))


def p9_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every document."""
    return consistent_forms(table(spark, folder, "documents")).select("doc_id", "form")


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with the class of those that look like it."""
    return look_classes(table(spark, folder, "documents"))


def p9_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with tokens that mix look-alikes of several scripts, or could stand whole in another script."""
    return script_report(table(spark, folder, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_neighbours": p1_neighbours, "p1_exact": p1_exact,
    "p2_found": p2_found, "p2_pairs": p2_pairs,
    "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p4_redacted": p4_redacted, "p6_found": p6_found, "p6_kinds": p6_kinds,
    "p7_found": p7_found, "p7_items": p7_items, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_forms": p9_forms, "p9_classes": p9_classes, "p9_scripts": p9_scripts}

ORACLES: dict[str, str] = {
    "p1_exact": """
WITH u AS (
  SELECT id, embedding::DOUBLE[] AS v FROM code_nodes
  WHERE id IS NOT NULL AND len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC NULLS LAST) = 1),
r AS (
  SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.id) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r
""",
}
