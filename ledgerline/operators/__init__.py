"""Single DataFrame operators the reports are built from."""
