"""python -m riskframe prepare RAW_FOLDER OUTPUT_FOLDER

Reads the four raw CSV tables of the card-payment layout, audits and joins
them, and writes the verified model-ready datasets with their reports.
"""

from __future__ import annotations

import argparse
import json

from riskframe.plans.prepare import Options, join_and_audit, prepare, write_prepared
from riskframe.plans.reports import write_reports
from riskframe.session import get_session
from riskframe.sources.files import csv_header, file_inventory, read_csv, require_size, write_report
from riskframe.sources.schemas import identity_schema, normalise_header, transaction_schema
from riskframe.spec import CARD_PAYMENTS

# Names of the raw files.
TRANSACTIONS = {"train": "train_transaction.csv", "test": "test_transaction.csv"}
IDENTITIES = {"train": "train_identity.csv", "test": "test_identity.csv"}


def main() -> None:
    parser = argparse.ArgumentParser(prog="riskframe", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    command = commands.add_parser("prepare", help="raw CSV tables to model-ready datasets")
    command.add_argument("raw")
    command.add_argument("output")
    command.add_argument("--config", help="JSON file with fields of Options")
    command.add_argument("--min-bytes", type=int, default=500 * 1024 * 1024)
    arguments = parser.parse_args()

    options = {}
    if arguments.config:
        with open(arguments.config, encoding="utf-8") as handle:
            options = json.load(handle)
    spark = get_session("riskframe-prepare")
    inventory = file_inventory(spark, f"{arguments.raw}/*.csv")
    require_size(inventory, arguments.min_bytes)
    write_report(inventory, f"{arguments.output}/reports/source_inventory")

    def table(name: str, builder):
        path = f"{arguments.raw}/{name}"
        return read_csv(spark, path, builder(normalise_header(csv_header(spark, path))))

    transactions = {k: table(v, transaction_schema) for k, v in TRANSACTIONS.items()}
    identities = {k: table(v, identity_schema) for k, v in IDENTITIES.items()}
    joined = join_and_audit(transactions, identities, CARD_PAYMENTS)
    write_reports(joined["train"], CARD_PAYMENTS, f"{arguments.output}/reports")
    prepared = prepare(joined["train"], joined["test"], CARD_PAYMENTS, Options(**options))
    write_prepared(prepared, CARD_PAYMENTS, arguments.output)


if __name__ == "__main__":
    main()
