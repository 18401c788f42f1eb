"""Registered queries.  Importing this package fills :data:`registry.QUERIES`."""

from jobsignal.plans import registry  # noqa: F401
from jobsignal.plans import postings  # noqa: F401
from jobsignal.plans import store  # noqa: F401
from jobsignal.plans import health  # noqa: F401
from jobsignal.plans import alerts  # noqa: F401
from jobsignal.plans import discovery  # noqa: F401
from jobsignal.plans import sources  # noqa: F401
from jobsignal.plans import streams  # noqa: F401
from jobsignal.plans import extras  # noqa: F401
