"""Reconcile two tables of any size with Spark."""

from twinledger.operators.reconcile import ReconResult, reconcile
from twinledger.plans.compare import FileComparison, compare_files
from twinledger.plans.job import StoredRun, load_run, run_recon_job
from twinledger.plans.report import report_tables, write_report
from twinledger.sources.read import LoadedTable, read_table
from twinledger.spec import CompareRules, JobConfig, TableSpec

__all__ = [
    "CompareRules",
    "FileComparison",
    "JobConfig",
    "LoadedTable",
    "ReconResult",
    "StoredRun",
    "TableSpec",
    "compare_files",
    "load_run",
    "read_table",
    "reconcile",
    "report_tables",
    "run_recon_job",
    "write_report",
]
