"""veilspark: privacy analytics on PySpark DataFrames.

Text scanning and redaction, form-element classification, page digests, box
geometry and fusion, evaluation, telemetry and training-data operators. Every
operator takes and returns DataFrames or Columns and leaves the physical plan
to Catalyst.
"""

__version__ = "0.1.0"
