"""Document-corpus analytics on PySpark.

Layout analysis, ranked keyword search, recognition-response ingestion, job
bookkeeping and Markdown corpus processing, written as DataFrame -> DataFrame
operators and Column -> Column functions.
"""

__version__ = "0.1.0"
