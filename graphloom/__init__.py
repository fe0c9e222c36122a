"""Dependency facts as Spark tables: import graphs, rules over them, and differences of snapshots."""

from .operators.cycles import cycles
from .operators.diff import diff_collection
from .operators.edges import metrics, module_edges
from .operators.modules import infer_modules
from .operators.rules import BUILTIN_RULE_PACK, BUILTIN_RULES, create_context, create_registry, evaluate_rules
from .plans.analyze import SnapshotComparisonError, analyze_git_ref, analyze_project, diff_snapshots
from .plans.render import dot, sarif, sarif_log
from .sources.schemas import IR_CONTRACT, IR_VERSION, TOOL_VERSION
from .sources.snapshots import SnapshotReceiptError, SnapshotShapeError, assert_snapshot, load_snapshot, validate_snapshot, verify_receipt

__all__ = [
    "BUILTIN_RULES", "BUILTIN_RULE_PACK", "IR_CONTRACT", "IR_VERSION", "SnapshotComparisonError", "SnapshotReceiptError", "SnapshotShapeError", "TOOL_VERSION",
    "analyze_git_ref", "analyze_project", "assert_snapshot", "create_context", "create_registry", "cycles", "diff_collection", "diff_snapshots", "dot", "evaluate_rules",
    "infer_modules", "load_snapshot", "metrics", "module_edges", "sarif", "sarif_log", "validate_snapshot", "verify_receipt",
]
