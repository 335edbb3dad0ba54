from gridloom.streaming.landing import land_latest_months, land_months

__all__ = ["land_latest_months", "land_months"]
