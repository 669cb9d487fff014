"""Pages to stored tables and QA rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellquery.functions import text
from cellquery.operators import matching, questions
from cellquery.operators.sections import read_sections
from cellquery.operators.tables import explode_tables, nested_cells, table_list, type_cells
from cellquery.session import materialize


@dataclass
class Harvest:
    """Results of a harvest: sections, tables and their typed cells, and statements numbered for QA rows."""

    sections: DataFrame
    tables: DataFrame
    cells: DataFrame
    statements: DataFrame

    def qa(self, candidates: DataFrame | None = None) -> DataFrame:
        """QA rows; without candidates the questions are left open."""
        return questions.build_qa(self.statements, questions.section_context(), candidates)

    def _kept(self) -> DataFrame:
        """The key of the table that each display name stands for.

        Where two pages give one name, the later page's table is kept, as it would replace the other.
        """
        named = self.tables.withColumn("table_id", questions.section_context())
        return named.groupBy("table_id").agg(F.max(F.struct(*matching.TABLE_KEYS)).alias("_kept")).select("_kept.*")

    def stored_tables(self) -> DataFrame:
        """``table_id, header, n_rows, n_cols`` under the display name, also of tables without rows."""
        return self.tables.join(self._kept(), matching.TABLE_KEYS, "left_semi").select(
            questions.section_context().alias("table_id"), "header", "n_rows", "n_cols"
        )

    def stored_cells(self) -> DataFrame:
        """Cells under their display ``table_id``, as ``save_cells`` takes them."""
        return self.cells.join(self._kept(), matching.TABLE_KEYS, "left_semi").select(
            questions.section_context().alias("table_id"), "row_idx", "col_idx", "col_name", "col_type", "cell"
        )


def harvest(
    pages: DataFrame, start: int = 0, strict: bool = True, numbers_only: bool = False, null_as_nan: bool = False
) -> Harvest:
    """Read every page once, match its cells to its sentences and number the statements.

    A section's paragraph and tables are one row, so matching takes no shuffle.
    """
    sections = materialize(read_sections(pages))
    keyed = explode_tables(sections.drop("paragraph"))
    spoken = sections.filter(F.size("tables") > 0).select(
        *matching.SECTION_KEYS, "url", "section_id", "tables",
        matching.said(text.sentences(F.col("paragraph"), strict)).alias("_said"),
    )
    nested = nested_cells(explode_tables(spoken), null_as_nan=null_as_nan)
    hits = matching.match_tables(nested, beside=["url", "section_id"])
    if numbers_only:
        hits = matching.numeric_only(hits)
    cells = type_cells(keyed, null_as_nan=null_as_nan)
    return Harvest(sections, table_list(keyed), cells, questions.statements(hits, start))
