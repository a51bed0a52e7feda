"""Registered queries: the operators over the tables of a data folder, with their SQL."""
