from .scalars import (format_bytes, format_metric, is_float_type, is_integer_like,
                      is_missing, percent, quoted, run_duration, run_seconds, safe_name,
                      title_case, truncate)

__all__ = ["format_bytes", "format_metric", "is_float_type", "is_integer_like", "is_missing",
           "percent", "quoted", "run_duration", "run_seconds", "safe_name", "title_case", "truncate"]
