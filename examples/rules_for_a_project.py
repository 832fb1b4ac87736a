"""Rules for a project in two formats, without a model: ``python examples/rules_for_a_project.py PATH``."""

import sys
import tempfile

from pyspark.sql import SparkSession

from textloom import config
from textloom.operators import reports
from textloom.plans.run import run

root = sys.argv[1] if len(sys.argv) > 1 else "."
spark = SparkSession.builder.appName("example").getOrCreate()
settings = config.load({"formats": "claude,generic", "compress": True, "on_conflict": "skip", "chunk_size": 4000}, cwd=root)
result = run(spark, root, settings, work=tempfile.mkdtemp())
result.report.orderBy("language").show(truncate=False)
print(*reports.validation_lines(result.findings), *result.summary, sep="\n")
