"""Registered queries: every operator as a plan over the driver's tables, with its SQL twin."""
