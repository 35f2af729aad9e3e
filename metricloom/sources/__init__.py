"""Where data and contracts come from and go to."""
