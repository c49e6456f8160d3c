"""Image-plate analytics and training-data cleaning as Spark DataFrame operators."""

import os


def reach_workers(spark) -> None:
    """Python workers look for this package where the driver found it; on a cluster it is shipped with --py-files or installed."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [*known, root]))
