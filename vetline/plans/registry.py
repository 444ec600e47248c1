"""All registered queries and their check SQL."""

from vetline.plans import cleaning, evaluation, models, profiling, services

QUERIES, ORACLES = {}, {}
for module in (cleaning, profiling, evaluation, models, services):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
