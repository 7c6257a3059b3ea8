"""What lies outside the engine: media in, tables out. Each step is a callable to plug in; without one it says so."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

#: step -> the table that it must produce.
STEPS = {
    "fetch": "a local media file for a URL",
    "probe": "video_info(width int, height int, fps double, duration double, frames bigint)",
    "frames": "frames(episode_id, k int, t double, image binary)",
    "audio": "audio(episode_id, samples array<float>)",
    "transcribe": "segments and words",
    "loudness": "loudness(episode_id, raw string)",
    "detect": "detections(episode_id, k, x, y, w, h, skin, votes)",
    "render": "one file for each planned run",
    "grab": "one image for each cover time",
}
_plugged: dict[str, Callable] = {}


class NotAvailable(RuntimeError):
    pass


def plug(step: str, f: Callable) -> None:
    if step not in STEPS:
        raise ValueError(f"no such step: {step}")
    _plugged[step] = f


def call(step: str, *args: object, **kwargs: object) -> object:
    if step not in _plugged:
        raise NotAvailable(f"{step} is not part of this engine; plug in what makes {STEPS[step]}")
    return _plugged[step](*args, **kwargs)


def is_url(value: str) -> bool:
    return bool(re.match(r"(?i)https?://", value.strip()))


def format_selector(height: int = 720) -> str:
    """What a downloader is asked for: up to a height, in falling order of preference."""
    return "/".join((f"bestvideo[height<={height}][ext=mp4]+bestaudio[ext=m4a]", f"bestvideo[height<={height}]+bestaudio", f"best[height<={height}]", "best"))


def download_options(folder: str, height: int = 720, quiet: bool = False) -> dict:
    # The downloader's option names.
    options = {"format": format_selector(height), "outtmpl": os.path.join(folder, "%(id)s.%(ext)s"), "merge_output_format": "mp4", "noplaylist": True, "retries": 3}
    return options | dict.fromkeys(("quiet", "no_warnings", "noprogress"), quiet)


def resolve(value: str, folder: str = "downloads", height: int = 720) -> str:
    """A local path for a path or URL."""
    if is_url(value):
        return str(call("fetch", value, download_options(folder, height)))
    if not os.path.exists(value):
        raise FileNotFoundError(value)
    return value
