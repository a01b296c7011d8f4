"""Command line: python -m urbanloom.cli run|invert|counterfactual --config FILE."""

from __future__ import annotations

import argparse

from urbanloom.plans import config as configuration
from urbanloom.plans import stages
from urbanloom.session import build_session


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="urbanloom")
    parser.add_argument("command", choices=["run", "invert", "counterfactual"], help="run: all stages; invert: save the baseline's inversion; counterfactual: solve from the saved one")
    parser.add_argument("--config", required=True)
    parser.add_argument("--prepare-only", action="store_true")
    parser.add_argument("--model-only", action="store_true")
    parser.add_argument("--skip-maps", action="store_true", help="leave out the map classes; maps are tables and are not drawn")
    given = parser.parse_args(arguments)
    config, _ = configuration.load_config(given.config)
    invert, saved = given.command == "invert", given.command == "counterfactual"
    tables = stages.run(build_session(), config, given.prepare_only, given.model_only, given.skip_maps, print, invert, saved)
    for name in sorted(tables):
        print(name)
    if "console_summary" in tables:
        tables["console_summary"].show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
