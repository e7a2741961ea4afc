"""Table functions over HTML, for lateral joins from SQL: cells of tables, and nodes of a page's listed menu.

    register(spark)
    SELECT page_id, c.* FROM pages, LATERAL html_cells(html) c

Rows are streamed, one for each cell or node; nothing is gathered in a column. Defined
cases: a null or empty page has no rows; cells that span rows or columns are there once
for each place that they fill, short rows are filled with empty cells; tables inside
tables count as tables of their own, in document order; markup is read as by ``dom.tree``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from loomwell.functions import dom


@udtf(returnType="table_no int, row_no int, column_no int, text string, header boolean")
class HtmlCells:
    """Each place of each table's grid."""

    def eval(self, html: str):
        for i, table in enumerate(dom.tree(html).all("table")):
            for j, row in enumerate(dom.grid(table)):
                for k, (text, header) in enumerate(row):
                    yield i, j, k, text, header


@udtf(returnType="node_no int, parent_no int, tag string, id string, classes string, text string")
class HtmlNodes:
    """Each element in document order, the number of the one that it is in (null at the top), and its own text."""

    def eval(self, html: str):
        root = dom.tree(html)
        number = {id(root): None}
        for i, n in enumerate(root.walk()):
            number[id(n)] = i
            own = " ".join(" ".join(c for c in n.children if isinstance(c, str)).split()) if n.tag not in ("script", "style") else ""
            yield i, number[id(n.parent)], n.tag, n.attrs.get("id"), n.attrs.get("class"), own


def register(spark: SparkSession) -> None:
    """``html_cells`` and ``html_nodes`` as SQL table functions of this session."""
    spark.udtf.register("html_cells", HtmlCells)
    spark.udtf.register("html_nodes", HtmlNodes)
