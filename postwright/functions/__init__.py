"""Columns from columns: text cleaning, ids, times and vectors."""
