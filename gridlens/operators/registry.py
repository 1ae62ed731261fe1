"""Read tools by name: functions from cells to a DataFrame. `operators.sql` has the same tools as SQL table functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from gridlens.operators import read

Tool = Callable[..., DataFrame]


class Registry:
    """Names to tools. A name taken twice is an error, so is one that is not known."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def add(self, name: str, tool: Tool) -> Tool:
        if name in self._tools:
            raise ValueError(f"a tool named {name} is there")
        self._tools[name] = tool
        return tool

    def get(self, name: str) -> Tool:
        return self._tools[name]

    def names(self) -> list[str]:
        return sorted(self._tools)


TOOLS = Registry()
for _name, _tool in (
    ("list_sheets", read.sheets), ("workbook_summary", read.workbooks), ("peek_sheet", read.peek), ("sample_rows", read.sample_rows), ("read_range", read.read_range), ("read_row", read.read_row),
    ("read_relative", read.read_relative), ("get_cell_at", read.cell_at), ("get_merged_regions", read.merged_regions), ("count_non_empty_rows_in_column", read.count_non_empty), ("find_value", read.find_value),
):
    TOOLS.add(_name, _tool)
