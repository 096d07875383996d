"""SQL text helpers and number formatting.

Large expressions are written as SQL text and parsed once by Spark; building
them call by call from Python takes seconds of driver time per query.
"""


def quoted(text: str) -> str:
    """A SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def double(number: float) -> str:
    """A SQL double literal; without the suffix it would be a decimal."""
    return f"{float(number)!r}D"


def text_list(values: list[str]) -> str:
    return ", ".join(quoted(v) for v in values)


def fixed(value: str, places: int) -> str:
    """Text with a fixed number of decimals, half away from zero."""
    return f"cast(try_cast(round({value}, {places}) as decimal(20,{places})) as string)"


def joined(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def array_of(parts: list[str]) -> str:
    """Array of the parts that are not null."""
    return f"array_compact(array({', '.join(parts)}))"
