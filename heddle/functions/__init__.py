"""Part of heddle."""
