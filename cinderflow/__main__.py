"""python -m cinderflow score|portfolio|query|queries|indicators: a thin command line over the engine.

score DIR OUT [PROFILE.toml]      builds and keeps a profile's scores of the tables in DIR
portfolio DIR OUT [PROFILE.toml]  allocates the profile's fund and keeps it as CSV
query NAME DIR                    runs a registered query and prints its first rows
queries                           names of all registered queries
indicators                        names of the registered indicators
"""

import sys
from pathlib import Path


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str]) -> int:
    from cinderflow import service
    from cinderflow.config import load_profile, portfolio_settings
    from cinderflow.operators import portfolio, scoring
    from cinderflow.plans import catalogue, fixtures
    from cinderflow.sources import files

    match args:
        case ["score" | "portfolio" as what, folder, out, *rest]:
            spark = session()
            profile = load_profile(Path(rest[0]).read_text(encoding="utf-8")) if rest else fixtures.PROFILE
            universe, facts, catalog = fixtures.universe(spark, folder), fixtures.facts(spark, folder), fixtures.catalog(spark)
            if what == "score":
                service.build_scores(universe, facts, catalog, profile, out).show(10, False)
            else:
                scores = scoring.score_profile(universe, facts, catalog, profile)
                fund = portfolio.allocate(scores, universe, portfolio_settings(profile))
                kept = fund.select("ticker", "weight", "benchmark_weight", "active_weight", "status", "reason")
                files.write_csv(kept.orderBy(kept["weight"].desc(), "ticker"), f"{out}/{profile.name}/portfolio")
                portfolio.summary(fund).show(1, False, True)
        case ["query", name, folder]:
            catalogue.queries()[name](session(), folder).show(20, False)
        case ["queries"]:
            print("\n".join(sorted(catalogue.queries())))
        case ["indicators"]:
            print("\n".join(sorted(service.INDICATORS)))
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
