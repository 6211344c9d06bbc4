"""A recorded exchange for the paged source's test."""


def fetch(symbol, start, end, interval):
    return [(t, 1, 2, 0.5, 1.5, 10) for t in range(start, end + 1, interval)]
