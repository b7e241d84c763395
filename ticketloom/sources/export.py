"""CSV export of any relation."""

from pyspark.sql import DataFrame


def export_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV parts with a header each, written by all tasks in parallel."""
    df.write.options(header="true", quote='"', escape='"', emptyValue="").csv(path)
