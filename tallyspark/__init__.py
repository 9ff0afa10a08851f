"""tallyspark: document-to-ledger processing and accounts-payable analytics on Spark.

Every public function takes DataFrames (or Columns) and returns a DataFrame (or Column);
nothing is collected to the driver and nothing loops over files or rows.
"""
