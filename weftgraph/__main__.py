"""``python -m weftgraph ROOT COMMAND...``: one catalogue command; ``query NAME FILE [OUT]`` runs a query file."""

import sys

from pyspark.sql import SparkSession

from weftgraph.service import Catalog, read_query, run_command
from weftgraph.sources.sinks import write_result


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    catalog = Catalog(SparkSession.builder.appName("weftgraph").getOrCreate(), args[0])
    if args[1] == "query" and len(args) >= 4:
        catalog.load(args[2])
        if len(args) > 4:
            write_result(catalog.query(read_query(args[3])), args[4])
        else:
            print(run_command(catalog, "query " + read_query(args[3])))
        return 0
    print(run_command(catalog, " ".join(args[1:])))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
