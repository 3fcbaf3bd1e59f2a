from datetime import date, timedelta


def days(start: str, n: int) -> list[date]:
    first = date.fromisoformat(start)
    return [first + timedelta(i) for i in range(n)]


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]
