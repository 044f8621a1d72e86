"""The command line: ``python -m skarn COMMAND ...``.

scan URL OUTPUT                        a snapshot of a target
compare SOURCE TARGET OUTPUT           matches, findings and reports of two snapshots
export-plan SOURCE OUTPUT              the plan of a complete export of a snapshot
export-approve PLAN OUTPUT             an approval of exactly this plan
export-dry-run PLAN APPROVAL TARGET OUTPUT   what an export would do to a target (an address or a folder of listings)
validate SOURCE TARGET                 a migrated target against its source
doctor TARGET                          whether a target answers, and what it knows
schemas OUTPUT                         the JSON Schemas of all that is stored

Ends with 0 if all is well, 1 if there is something to look at, 2 if the command cannot be done. Nothing is ever sent to a target but GET.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

ARGUMENTS = {
    "scan": ("url", "output"), "compare": ("source", "target", "output"), "export-plan": ("source", "output"), "export-approve": ("plan", "output"),
    "export-dry-run": ("plan", "approval", "target", "output"), "validate": ("source", "target"), "doctor": ("target",), "schemas": ("output",),
}
OPTIONS = {
    "scan": ("--token-env", "--tool"), "export-plan": ("--on-conflict", "--target-fingerprint"), "export-approve": ("--operator", "--note"),
    "export-dry-run": ("--token-env",), "validate": ("--plan",), "doctor": ("--token-env",),
}


def parser() -> argparse.ArgumentParser:
    whole = argparse.ArgumentParser(prog="skarn", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = whole.add_subparsers(dest="command", required=True)
    for name, places in ARGUMENTS.items():
        command = commands.add_parser(name)
        for place in places:
            command.add_argument(place)
        for option in OPTIONS.get(name, ()):
            command.add_argument(option, **({"choices": ("fail", "replace-managed"), "default": "fail"} if option == "--on-conflict" else {}))
    return whole


def run(given: argparse.Namespace, spark) -> tuple[dict, bool]:
    """What a command has to say, and whether there is something to look at."""
    from skarn.plans import compare, export, inspect
    from skarn.sources import schemas, target
    from skarn.sources.snapshot import Folder

    def listings(where: str) -> list:
        return [target.listing(spark, where, kind, given.token_env)[0] for kind in ("folders", "notes", "resources")]

    if given.command == "scan":
        manifest = target.scan_target(spark, given.url, given.output, given.token_env, given.tool)
        return {"snapshot": given.output, "records": manifest["record_counts"], "coverage": manifest["coverage_status"]}, manifest["coverage_status"] != "complete"
    if given.command == "compare":
        counts = compare.compare(spark, given.source, given.target, given.output)
        return counts, bool(set(counts.get("kind", {})) - {"representation-only"})
    if given.command == "export-plan":
        header = export.plan_of_snapshot(spark, given.source, given.output, given.on_conflict, given.target_fingerprint or "")
        return {k: header[k] for k in ("plan_id", "n_folders", "n_notes", "conflict_policy")}, False
    if given.command == "export-approve":
        text = Folder(spark, given.plan).read_text("plan.json")
        approval = export.approval(text.encode(), given.operator or "", given.note or "")
        Folder(spark, given.output).write_text("approval.json", json.dumps(approval, sort_keys=True))
        return approval, False
    if given.command == "export-dry-run":
        approval = json.loads(Folder(spark, given.approval).read_text("approval.json"))
        receipt, steps = export.dry_run(export.load_plan(spark, given.plan), approval, *listings(given.target))
        steps.orderBy("place").write.json(f"{given.output}/operations")
        Folder(spark, given.output).write_text("receipt.json", json.dumps(receipt, sort_keys=True, indent=1))
        return receipt | {"operations": steps.count()}, receipt["result"] != "ok"
    if given.command == "validate":
        kinds = {r["kind"]: r["count"] for r in compare.check_export(spark, given.source, given.target, given.plan).groupBy("kind").count().collect()}
        return kinds, bool(kinds)
    if given.command == "doctor":
        folders, notes, resources = listings(given.target)
        known = target.capabilities(given.target, os.environ.get(given.token_env) if given.token_env else None) if given.target.startswith("http") else {}
        counts = inspect.profile_counts(folders, notes, resources)
        return {"capabilities": known, "instance_fingerprint": inspect.instance_fingerprint(folders), "counts": counts, "mutating_requests_sent": 0}, False
    return {"schemas": schemas.write_schemas(spark, given.output)}, False


def main(arguments: list[str] | None = None, spark=None) -> int:
    given = parser().parse_args(arguments)
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        told, look = run(given, spark)
    except (ValueError, OSError) as error:  # a file that is there already, a plan that is not allowed, an address that does not answer
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 2
    print(json.dumps(told, ensure_ascii=False, sort_keys=True))
    return int(look)


if __name__ == "__main__":
    sys.exit(main())
