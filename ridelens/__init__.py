"""Ride-funnel analytics on Spark.

Five source tables (app downloads, signups, ride requests, transactions,
reviews) feed a four-step conversion funnel at several grains, demand,
charge, driver and review statistics, and the parameterised datasets
behind a dashboard.  Everything is a lazy DataFrame plan: no Python UDFs,
no driver-side loops over data.
"""

from ridelens.session import build_session, checkpoint_dir
from ridelens.sources.tables import RideTables

__all__ = ["RideTables", "build_session", "checkpoint_dir"]
