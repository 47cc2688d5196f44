"""Made-up prose for tests."""


def prose(draw, n):
    parts = ["th", "er", "on", "an", "re", "ti", "es", "or", "é", "ll"]
    words = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(n)]
    return " ".join(words).capitalize() + "."
