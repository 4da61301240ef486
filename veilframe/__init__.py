"""Find, mask and restore sensitive data in Spark DataFrames."""

from veilframe.plans.jobs import (  # noqa: F401
    MaskResult,
    Project,
    audit,
    mask,
    mask_batch,
    mask_files,
    mask_rows,
    mask_table,
    restore,
    restore_files,
    restore_group,
    restore_rows,
    scan_report,
)
from veilframe.sources.sessions import expire, sessions  # noqa: F401
