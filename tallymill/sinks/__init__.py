"""Writing results: report files, table formats, catalog tables, cell stores."""
