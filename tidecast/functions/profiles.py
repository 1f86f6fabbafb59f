"""Shapes of events around an anchor, as expressions of the microseconds from the anchor."""

from __future__ import annotations

import logging
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecast.functions.durations import micros

log = logging.getLogger(__name__)


class Profile:
    """A shape; ``at`` is its value so many microseconds after the anchor."""

    def at(self, us: Column) -> Column:
        raise NotImplementedError

    def reach(self) -> tuple[int, int] | None:
        """Microseconds before and after the anchor beyond which the shape is zero in double precision; None if it has no end."""
        return None

    def to_dict(self) -> dict:
        return {"type": type(self).__name__, **asdict(self)}

    @staticmethod
    def from_dict(data: dict) -> Profile:
        if "type" not in data:
            raise KeyError("a profile needs its type")
        if data["type"] not in PROFILES:
            raise NotImplementedError(f"no profile {data['type']!r}")
        return PROFILES[data["type"]](**{k: v for k, v in data.items() if k != "type"})


@dataclass(frozen=True)
class BoxCar(Profile):
    """One from the anchor on for ``width``, else zero."""

    width: str | int

    def at(self, us: Column) -> Column:
        return F.when((us >= 0) & (us < micros(self.width)), 1.0).otherwise(0.0)

    def reach(self) -> tuple[int, int]:
        return 0, max(micros(self.width), 0)


@dataclass(frozen=True)
class Gaussian(Profile):
    """exp(-(z²/2)^order) with z in widths; larger orders flatten the top."""

    width: str | int
    order: float = 1.0

    def __post_init__(self) -> None:
        if self.order <= 0:
            raise ValueError("order must be positive")

    def at(self, us: Column) -> Column:
        z = us / F.lit(float(micros(self.width)))
        return F.exp(-F.pow(0.5 * z * z, F.lit(float(self.order))))

    def reach(self) -> tuple[int, int]:
        end = math.ceil(micros(self.width) * math.sqrt(2 * 746 ** (1 / self.order)))  # exp(-746) is zero
        return end, end


@dataclass(frozen=True)
class Cauchy(Profile):
    """1 / (1 + 4 z²) with z in widths: half the height at half a width."""

    width: str | int

    def at(self, us: Column) -> Column:
        z = us / F.lit(float(micros(self.width)))
        return 1.0 / (1.0 + 4.0 * z * z)


@dataclass(frozen=True)
class Exponential(Profile):
    """Halves every ``lead`` before the anchor and every ``lag`` from it on; a side without width is zero, and so is all from a distance of ``end`` on."""

    lead: str | int = 0
    lag: str | int = 0
    end: str | int | None = None

    def __post_init__(self) -> None:
        for side in ("lead", "lag"):
            if micros(getattr(self, side)) < 0:
                log.warning("negative %s counts as zero", side)
                object.__setattr__(self, side, 0)
        if self.end is not None and micros(self.end) <= 0:
            raise ValueError("end must be positive")
        if not micros(self.lead) and not micros(self.lag):
            log.warning("lead and lag are both zero: the profile is zero everywhere")

    def at(self, us: Column) -> Column:
        lead, lag = float(micros(self.lead)), float(micros(self.lag))
        before = F.pow(F.lit(2.0), us / F.lit(lead)) if lead else F.lit(0.0)
        after = F.pow(F.lit(2.0), -us / F.lit(lag)) if lag else F.lit(0.0)
        value = F.when(us < 0, before).otherwise(after)
        return value if self.end is None else F.when(F.abs(us) < micros(self.end), value).otherwise(0.0)

    def reach(self) -> tuple[int, int]:
        sides = 1076 * micros(self.lead), 1076 * micros(self.lag)  # 2^-1076 is zero
        return sides if self.end is None else tuple(min(x, micros(self.end)) for x in sides)


PROFILES: dict[str, type[Profile]] = {c.__name__: c for c in (BoxCar, Gaussian, Cauchy, Exponential)}


def register_profile(cls: type[Profile]) -> type[Profile]:
    """Make a class of one's own known by its name, so that specs with it can be read back; usable as a decorator."""
    PROFILES[cls.__name__] = cls
    return cls
