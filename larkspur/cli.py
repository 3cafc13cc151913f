"""`python -m larkspur.cli FOLDER`: reads statements, ended by `;`, and prints their results. `.help`, `.exit`."""

from __future__ import annotations

import sys

from larkspur.errors import EngineError
from larkspur.session import Engine

HELP = ".help    this text\n.exit    leave\nstatement;    run it (BEGIN, COMMIT and ROLLBACK too)"


def main(argv: list[str]) -> int:
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    if len(argv) != 1:
        print(__doc__)
        return 2
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, argv[0])
    text = ""
    for line in sys.stdin:
        word = line.strip()
        if not text and word in (".exit", ".help"):
            if word == ".exit":
                break
            print(HELP)
            continue
        text += line
        if word.endswith(";"):
            try:
                engine.sql(text).show(1000, truncate=False)
            except (EngineError, PySparkException) as e:
                print(f"error: {e}")
            text = ""
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
