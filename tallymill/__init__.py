"""Ready-made Spark data jobs: reports, table writes, log pipelines, status
histories, run statistics, layered merging and capacity rollups.

Every job takes and returns DataFrames.
"""

__version__ = "0.1.0"
