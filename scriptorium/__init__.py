"""A PySpark library for digitised archival text, entity reconciliation and catalogue records."""
