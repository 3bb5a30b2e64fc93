"""Validated option objects shared by the operators."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

NS_PER_S = 1_000_000_000


class OptionError(ValueError):
    """A missing, mistyped or out-of-range option."""


@dataclass(frozen=True)
class WindowOptions:
    """Windowing, history and sampling options. Lengths are in seconds.

    ``slices`` splits each time window of a source into that many sub-ranges, so that
    a source flooding one window is still spread over several tasks.
    ``history_block`` bounds how many windows of one source a single group may hold.
    ``history_timeout=None`` switches the expiry test off.
    """

    window_length: float
    history_min: int = 6
    history_timeout: float | None = 120
    packets_min: int = 15
    samples_size: int = 40
    threshold: float | None = None
    flush_last: bool = False
    slices: int = 16
    history_block: int = 4096

    def __post_init__(self):
        for name in ("history_min", "packets_min", "samples_size", "slices", "history_block"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int):
                raise OptionError(f"{name} must be an integer")
            if value < 1:
                raise OptionError(f"{name} must be positive")
        for name in ("window_length", "history_timeout", "threshold"):
            value = getattr(self, name)
            if value is None and name != "window_length":
                continue
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise OptionError(f"{name} must be a numeric value")
        if self.window_ns < 1:
            raise OptionError("window_length must be positive")
        if self.history_timeout is not None and self.history_timeout <= 0:
            raise OptionError("history_timeout must be positive, or None for no expiry")
        # a source's first window never makes it ready, so 1 behaves as 2
        if self.history_min == 1:
            object.__setattr__(self, "history_min", 2)

    @property
    def window_ns(self) -> int:
        return int(self.window_length * NS_PER_S)

    @property
    def timeout_ns(self) -> int | None:
        return None if self.history_timeout is None else int(self.history_timeout * NS_PER_S)

    @property
    def slice_ns(self) -> int:
        return max(1, self.window_ns // self.slices)

    @classmethod
    def from_mapping(cls, *sections: dict) -> "WindowOptions":
        """Build from one or more configuration sections; unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        merged = {}
        for section in sections:
            merged.update({k: v for k, v in (section or {}).items() if k in known})
        if "window_length" not in merged:
            raise OptionError('mandatory parameter "window_length" is missing')
        return cls(**merged)

    @classmethod
    def from_yaml(cls, path: str, sections=("logger", "mitig_simulator")) -> "WindowOptions":
        import yaml

        with open(path, encoding="utf8") as handle:
            config = yaml.safe_load(handle) or {}
        return cls.from_mapping(*(config.get(name) or {} for name in sections))

    def with_changes(self, **changes) -> "WindowOptions":
        return WindowOptions(**{**asdict(self), **changes})
