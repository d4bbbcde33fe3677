"""Empty on purpose: no operator of the inventory streams; archives are bounded scans."""
