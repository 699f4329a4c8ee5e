"""Files, tables and the shared scratch folder. Import from the submodules."""
