"""Text of a frame's physical plan."""

from __future__ import annotations

import contextlib
import io


def plan_text(frame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain()
    return out.getvalue()
