"""Operators: functions from DataFrame to DataFrame. Import from the submodules."""
