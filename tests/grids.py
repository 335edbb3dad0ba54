"""What tests of grids share."""

from datetime import datetime

START = datetime(2020, 1, 1, 12)
