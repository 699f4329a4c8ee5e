"""File-arrival streams."""

from tablewright.streaming.arrivals import (append_to, arriving_files, drop_repeats, kept_table, maintain, route_valid,
                                            run_available)

__all__ = ["append_to", "arriving_files", "drop_repeats", "kept_table", "maintain", "route_valid", "run_available"]
