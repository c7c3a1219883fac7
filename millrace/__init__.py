"""millrace: PySpark operators and jobs for retail-review lakes and run telemetry."""

from millrace.session import persisted, pinned, session, staged, work_dir

__all__ = ["persisted", "pinned", "session", "staged", "work_dir"]
