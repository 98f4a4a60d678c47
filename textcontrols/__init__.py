"""textcontrols: text-experiment analytics on Spark DataFrames.

Every public operator takes and returns DataFrames; the planning and the
execution belong to Spark.  Sub-packages:

- ``sources``   readers and writers (Parquet tables, survey CSV, JSON metadata, snapshots)
- ``functions`` column expressions (text normalisation, word counts, recodes, t quantiles)
- ``operators`` DataFrame operators (matching, catalog, descriptives, regression, embeddings, validation)
- ``plans``     the registered queries over the driver tables, and their SQL oracles
- ``streaming`` the stateless enrichment applied to a streaming DataFrame
"""

from textcontrols.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
