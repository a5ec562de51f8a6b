"""Writing result paths as text, CSV or TSV."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("csv", "tsv", "txt", "efu")


class NoResults(Exception):
    """A search found nothing and was asked to treat that as an error."""

    exit_code = 9


def export(
    rows: DataFrame,
    format: str,
    folder: str,
    header: bool = True,
    on_empty: str | None = None,
) -> None:
    """Write the paths of ``rows`` in their order.

    CSV quotes every value and ends lines with CR LF; TSV quotes nothing; both
    have one header, in the first part, so that the parts in order are one file. Text
    (and ``efu``, which is the same) is one path per line.  ``on_empty`` is
    ``"error"`` to raise :class:`NoResults`, or ``"hide"`` to write nothing.
    """
    if format not in FORMATS:
        raise ValueError(f"unknown format: {format}")
    if on_empty and rows.isEmpty():
        if on_empty == "error":
            raise NoResults("no results")
        return
    path = F.col("path")
    ends = {"csv": "\r\n"}.get(format, "\n")
    quoted = F.concat(F.lit('"'), F.replace(path, F.lit('"'), F.lit('""')), F.lit('"'))
    lines = rows.select((quoted if format == "csv" else path).alias("value"))
    if header and format in ("csv", "tsv"):
        # The first part holds the header alone, so the parts in order are one valid file.
        title = '"Name"' if format == "csv" else "Name"
        first = rows.sparkSession.range(1, numPartitions=1).select(F.lit(title).alias("value"))
        lines = first.union(lines)
    lines.write.option("lineSep", ends).text(folder)
