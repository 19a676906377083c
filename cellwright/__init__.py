"""cellwright: data profiling, cleaning and correction on Spark.

The main entry points::

    from cellwright import get_spark, run_chain, detect_anomalies, find_cells, apply_decisions

    clean, results = run_chain(df, [{"type": "TRIM_WHITESPACE"}], order_by="id")
    anomalies = detect_anomalies(clean, "dataset-1", order_by="id")
    fixed = apply_decisions(clean, anomalies, decisions, order_by="id")
"""

__version__ = "0.1.0"

__all__ = ["get_spark", "run_chain", "run_chain_observed", "apply_transform", "detect_anomalies", "find_cells",
           "apply_decisions", "apply_correction", "parse_instructions", "read_table", "write_table"]


def __getattr__(name):
    # lazy re-exports: importing the package stays cheap (executors import it for one function)
    if name == "get_spark":
        from .session import get_spark
        return get_spark
    if name in ("run_chain", "run_chain_observed", "apply_transform"):
        from .operators import transforms
        return getattr(transforms, name)
    if name == "detect_anomalies":
        from .operators.detect import detect_anomalies
        return detect_anomalies
    if name == "find_cells":
        from .operators.cells import find_cells
        return find_cells
    if name in ("apply_decisions", "apply_correction"):
        from .operators import apply
        return getattr(apply, name)
    if name == "parse_instructions":
        from .plans.instructions import parse_instructions
        return parse_instructions
    if name in ("read_table", "write_table"):
        from .sources import io
        return getattr(io, name)
    raise AttributeError(name)
