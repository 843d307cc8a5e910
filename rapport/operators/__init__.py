"""DataFrame operators. Every clock is an explicit ``as_of`` argument."""
