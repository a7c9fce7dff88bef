"""Selections and chunk layouts, validated on the driver before a plan is built."""
