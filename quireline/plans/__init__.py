"""Plans that join operators end to end."""
