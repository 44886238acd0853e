"""Command-line options as parameters of the stages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

#: What options take.
LAYOUTS = {"0": "auto", "1": "single_uncut", "1.5": "page_plus_offcut", "2": "two_pages"}
ROTATIONS = {"left": 270, "right": 90, "upsidedown": 180}
COLOR_MODES = {"black_and_white": "bw", "color_grayscale": "color", "mixed": "mixed"}


@dataclass(frozen=True)
class Options:
    inputs: tuple[str, ...] = ()
    output: str = ""
    layout: str = "auto"
    right_to_left: bool = False
    rotation: int = 0
    deskew_mode: str = "auto"
    angle: float = 0.0
    content_box: tuple[float, float, float, float] | None = None
    content_detection: str = "normal"
    margins: dict = field(default_factory=lambda: {"left": 10.0, "top": 5.0, "right": 10.0, "bottom": 5.0})
    align_h: str | None = "center"
    align_v: str | None = "center"
    dpi: tuple[int, int] = (600, 600)
    output_dpi: tuple[int, int] = (600, 600)
    color_mode: str = "bw"
    white_margins: bool = False
    normalize_illumination: bool = False
    threshold: int = 0
    despeckle: str = "cautious"
    dewarping: str = "off"
    depth_perception: float = 2.0
    start_filter: int = 1
    end_filter: int = 6
    output_project: str | None = None


class UsageError(ValueError):
    pass


def axes(found: dict[str, str], name: str, default: tuple[int, int]) -> tuple[int, int]:
    """The whole value overrides those of the axes."""
    x, y = int(found.get(f"{name}-x", default[0])), int(found.get(f"{name}-y", default[1]))
    return (int(found[name]),) * 2 if name in found else (x, y)


def parse(args: list[str]) -> Options:
    """--name=value or --name; other arguments are inputs, the last one being the output directory. '-' reads names from a list."""
    found, rest = {}, []
    for a in args:
        if m := re.fullmatch(r"--([\w-]+)(?:=(.*))?", a):
            found[m[1]] = m[2] if m[2] is not None else ""
        else:
            rest.append(a)
    if not rest:
        raise UsageError("no input")
    o = Options(inputs=tuple(rest[:-1] or rest), output=rest[-1] if len(rest) > 1 else "")
    if "layout" in found:
        if found["layout"] not in LAYOUTS:
            raise UsageError("layout")
        o = replace(o, layout=LAYOUTS[found["layout"]])
    if "orientation" in found:
        if found["orientation"] not in ROTATIONS:
            raise UsageError("orientation")
        o = replace(o, rotation=ROTATIONS[found["orientation"]])
    o = replace(o, right_to_left=found.get("layout-direction", "lr") == "rl")
    if "rotate" in found or "deskew" in found:  # either makes the angle a manual one
        o = replace(o, deskew_mode="manual", angle=float(found.get("rotate") or 0))
    if "content-box" in found:
        m = re.fullmatch(r"([\d.]+)x([\d.]+):([\d.]+)x([\d.]+)", found["content-box"])
        if not m:
            raise UsageError("content-box")
        o = replace(o, content_box=tuple(map(float, m.groups())), content_detection=found.get("content-detection", "normal"))
    margins = {k: float(found[f"margins-{k}"]) if f"margins-{k}" in found else v for k, v in o.margins.items()}
    if "margins" in found:
        margins = dict.fromkeys(margins, float(found["margins"]))
    o = replace(o, margins=margins)
    for key, side in (("alignment-horizontal", "align_h"), ("alignment-vertical", "align_v")):
        if key in found:
            o = replace(o, **{side: found[key]})
    if found.get("alignment") == "original":
        o = replace(o, align_h=None, align_v=None)
    return replace(
        o, dpi=axes(found, "dpi", o.dpi), output_dpi=axes(found, "output-dpi", o.output_dpi), color_mode=COLOR_MODES.get(found.get("color-mode", ""), "bw"), white_margins="white-margins" in found,
        normalize_illumination="normalize-illumination" in found, threshold=int(found.get("threshold", 0)), despeckle=found.get("despeckle", o.despeckle), dewarping=found.get("dewarping", o.dewarping),
        depth_perception=float(found.get("depth-perception", o.depth_perception)), start_filter=bounded(found, "start-filter", 1), end_filter=bounded(found, "end-filter", 6), output_project=found.get("output-project"),
    )


def bounded(found: dict[str, str], name: str, default: int) -> int:
    n = int(found.get(name, default))
    if not 1 <= n <= 6:
        raise UsageError(name)
    return n
