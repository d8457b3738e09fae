"""Settings of a folder in its index, what they depend on, and what opening a folder leads to."""

from dataclasses import asdict, dataclass, fields

FLAGS = ("recurse", "within_a_folder", "ignore_colour", "whole_frame", "corners", "keep_index", "auto_rescan", "auto_mark")


@dataclass(frozen=True)
class Notes:
    """None: never noted, which is not the same as off."""

    recurse: bool | None = None
    within_a_folder: bool | None = None
    ignore_colour: bool | None = None
    whole_frame: bool | None = None
    corners: bool | None = None
    keep_index: bool | None = None
    auto_rescan: bool | None = None
    auto_mark: bool | None = None
    percent: float | None = None
    last_scan: int | None = None

    @classmethod
    def read(cls, catalogue) -> "Notes":
        held = {r.key: r.value for r in catalogue.table("meta").collect()}  # a handful of rows
        out = {k: held[k] == "1" for k in FLAGS if k in held}
        for name, kind in (("percent", float), ("last_scan", int)):
            try:
                out[name] = kind(held[name])
            except (KeyError, ValueError):
                continue
        return cls(**out)

    def write(self, catalogue) -> None:
        for f in fields(self):
            value = asdict(self)[f.name]
            if value is not None:
                catalogue.set_meta(f.name, str(int(value)) if f.name in FLAGS else str(value))

    def sound(self) -> "Notes":
        """Settings that another one switches off are off."""
        rescan = bool(self.auto_rescan and self.keep_index)
        return Notes(**asdict(self) | {"within_a_folder": bool(self.within_a_folder and self.recurse), "auto_rescan": rescan, "auto_mark": bool(self.auto_mark and rescan)})


def on_opening(moved: bool, auto_rescan: bool, saved_review: bool) -> str:
    """rescan, ask, review or search."""
    if moved:
        return "rescan" if auto_rescan or not saved_review else "ask"
    return "review" if saved_review else "search"


def read_settings(lines: list[str]) -> tuple[dict[str, str], list[str]]:
    """key=value lines of a user's settings file, and its earlier folders (repeated previous= lines), each once,
    in order without regard to case."""
    pairs = [x.strip().split("=", 1) for x in lines if "=" in x]
    previous = sorted({v for k, v in pairs if k == "previous"}, key=lambda x: (x.lower(), x))
    return {k: v for k, v in pairs if k != "previous"}, previous
