"""The weekday report as a job: ``python -m tallymill --input trips.csv --output report``.

To run on a cluster, submit it with ``spark-submit`` and the package as ``--py-files``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tallymill.operators.reports import weekday_report
from tallymill.sinks.files import show, write_report_csv
from tallymill.sources.files import read_csv


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallymill", description="Trips per day of the week")
    parser.add_argument("-i", "--input", required=True, help="CSV with a header, on any path")
    parser.add_argument("-o", "--output", help="folder for the report as CSV")
    parser.add_argument("--schema", help="column types as DDL, to read the input only once")
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("weekday report").getOrCreate()
    report = weekday_report(read_csv(spark, options.input, schema=options.schema))
    if options.output:
        # The written report is shown, so the trips are aggregated once.
        write_report_csv(report, options.output, order_by=["day_of_week"])
        report = read_csv(spark, options.output)
    show(report)


if __name__ == "__main__":
    main()
