from .stats import metrics_table, read_metrics, run_averages, run_report, write_metrics, write_report
from .text import component_lines, components_as_matrix, coo_lines, dense_lines, lil_lines, write_components, write_matrix, write_projection

__all__ = [
    "component_lines", "components_as_matrix", "coo_lines", "dense_lines", "lil_lines", "write_components", "write_matrix", "write_projection",
    "metrics_table", "read_metrics", "run_averages", "run_report", "write_metrics", "write_report",
]
