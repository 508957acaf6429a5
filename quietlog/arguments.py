"""Checks of report arguments; all raise before a plan is built."""

from dataclasses import dataclass

from quietlog.schema import DEFAULT_PAGE_SIZE, DEFAULT_STALE_DAYS, DEFAULT_UNUSED_DAYS, MAX_PAGE_SIZE


def positive_int(raw, field: str) -> int:
    """An integer of at least 1, also from text."""
    try:
        value = int(raw)
    except (TypeError, ValueError):
        raise ValueError(f"invalid {field}") from None
    if value < 1 or isinstance(raw, float):
        raise ValueError(f"invalid {field}")
    return value


@dataclass(frozen=True)
class Thresholds:
    stale_days: int = DEFAULT_STALE_DAYS
    unused_days: int = DEFAULT_UNUSED_DAYS

    @classmethod
    def of(cls, stale_days=None, unused_days=None) -> "Thresholds":
        """Given values override the defaults; stale >= 1, unused >= 1, unused >= stale."""
        stale = DEFAULT_STALE_DAYS if stale_days is None else positive_int(stale_days, "stale_days")
        unused = DEFAULT_UNUSED_DAYS if unused_days is None else positive_int(unused_days, "unused_days")
        if unused < stale:
            raise ValueError("unused_days must be greater than or equal to stale_days")
        return cls(stale, unused)


@dataclass(frozen=True)
class Page:
    number: int = 1
    limit: int = DEFAULT_PAGE_SIZE

    @classmethod
    def of(cls, page=None, limit=None) -> "Page":
        """Page from 1, limit from 1 and clamped to the maximum (T4)."""
        number = 1 if page is None else positive_int(page, "page")
        size = DEFAULT_PAGE_SIZE if limit is None else positive_int(limit, "limit")
        return cls(number, min(size, MAX_PAGE_SIZE))

    @property
    def offset(self) -> int:
        return (self.number - 1) * self.limit


# Accepted sort keys.
SORT_KEYS = ("name", "partitions", "age", "status", "empty", "messages")


def sort_arguments(sort_by: str | None, sort_dir: str | None) -> tuple[str, bool]:
    """(key, descending); unknown keys mean name, unknown directions ascending."""
    return (sort_by if sort_by in SORT_KEYS else "name"), sort_dir == "desc"
