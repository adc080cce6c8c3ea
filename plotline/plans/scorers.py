"""Scorers of the scoring queries: plain functions of a row's dict, imported by the workers."""


def screen(row: dict) -> dict:
    return {"passed": row["price"] % 2 == 0, "reason": None if row["price"] % 2 == 0 else "odd"}


def evaluate(row: dict) -> dict:
    if row["id"] % 50 == 0:
        raise ValueError("no answer")
    return {"overall_score": int(row["id"] % 10)}
