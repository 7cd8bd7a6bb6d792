"""Training-data attribution analytics on Spark DataFrames.

Every public function takes DataFrames (or paths) and returns DataFrames.  No
function pulls data rows to the driver; small scalars are read with scalar
subqueries, and lookups that travel with a plan are either fixed lists or sides
whose size is checked first.
"""

__version__ = "0.1.0"
