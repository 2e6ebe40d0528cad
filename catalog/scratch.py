"""A scratch folder for local sessions that set no spark.checkpoint.dir, removed at the end."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from tempora.plans import sizing

LOCAL = tempfile.mkdtemp(prefix="tempora-")
atexit.register(shutil.rmtree, LOCAL, ignore_errors=True)
sizing.name_local_scratch(LOCAL)
